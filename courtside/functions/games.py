"""Game rules: stage of a game, winner, result, side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import IN_PROGRESS, IN_PROGRESS_ORDER, STAGE_WORDS, STAGES
from .text import col, fold


def stage_from_game(phase: Column | str, round_: Column | str) -> Column:
    """Postseason stage named by phase and round; NULL in the regular season.

    All stage words are found in one pass over the text; the narrowest decides.
    """
    text = F.concat_ws(" ", fold(phase), fold(round_))
    words = F.regexp_extract_all(text, F.lit("(" + "|".join(word for word, _ in STAGE_WORDS) + ")"), F.lit(1))
    rank = F.create_map(*[F.lit(x) for i, (word, _) in enumerate(STAGE_WORDS) for x in (word, i)])
    narrowest = F.array_min(F.transform(words, lambda w: rank[w]))
    return F.get(F.array(*[F.lit(stage) for _, stage in STAGE_WORDS]), narrowest)


def _look_up(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def stage_order(stage: Column | str) -> Column:
    """Rank of a stage key; a finalist counts as runner-up until a champion is known."""
    ranks = {key: rank for key, (rank, _) in STAGES.items()} | {"final": STAGES["vice_campeao"][0]}
    return _look_up(ranks, col(stage)).cast("bigint")


def stage_label(order: Column | str) -> Column:
    """Label of a stage rank; NULL rank means nothing is known yet."""
    labels = {rank: label for rank, label in STAGES.values()} | {IN_PROGRESS_ORDER: IN_PROGRESS}
    return _look_up(labels, col(order).cast("int"))


def winner(home, away, home_score, away_score, stored=None) -> Column:
    """The stored winner, else the side with more points; a tie has none."""
    home_score, away_score = col(home_score), col(away_score)
    computed = F.when(home_score > away_score, col(home)).when(away_score > home_score, col(away))
    return computed if stored is None else F.coalesce(col(stored), computed)


def game_result(own: Column | str, other: Column | str) -> Column:
    own, other = col(own), col(other)
    return F.when(own > other, F.lit("W")).when(own < other, F.lit("L")).when(own == other, F.lit("T"))


def side_and_opponent(team, home, away, home_score, away_score) -> Column:
    """struct describing the game from one team's view; all NULL for a third team."""
    team, home, away = col(team), col(home), col(away)
    home_score, away_score = col(home_score), col(away_score)
    at_home, at_away = team == home, team == away

    def pick(if_home: Column, if_away: Column) -> Column:
        return F.when(at_home, if_home).when(at_away, if_away)

    own, other = pick(home_score, away_score), pick(away_score, home_score)
    return F.struct(
        pick(F.lit("home"), F.lit("away")).alias("home_away"),
        pick(away, home).alias("opponent_team_id"),
        own.alias("team_score"),
        other.alias("opponent_score"),
        game_result(own, other).alias("result"),
    )


def team_ids_for_side(side, home, away) -> Column:
    """struct(team_id, opponent_team_id) for a side of the page."""
    is_home = col(side) == "home"
    return F.struct(
        F.when(is_home, col(home)).otherwise(col(away)).alias("team_id"),
        F.when(is_home, col(away)).otherwise(col(home)).alias("opponent_team_id"),
    )


def is_finished() -> Column:
    """Both sides and both scores are known."""
    return (
        F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull()
        & F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    )
