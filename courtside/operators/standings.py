"""League tables: regular season, postseason finish, champions, standings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_COMPETITION, IN_PROGRESS_ORDER, STAGES
from ..functions.games import is_finished, stage_from_game, stage_label, stage_order, winner
from ..functions.stats import record_text, win_pct
from ..functions.text import blank_to_null

TABLE_KEY = ["season_id", "competition", "team_id"]


def _optional(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def finished_games(games: DataFrame) -> DataFrame:
    return games.filter(is_finished())


def with_stage(games: DataFrame) -> DataFrame:
    return games.withColumn("stage", stage_from_game(_optional(games, "phase"), _optional(games, "round")))


def regular_season_games(games: DataFrame) -> DataFrame:
    return with_stage(finished_games(games)).filter(F.col("stage").isNull())


def postseason_games(games: DataFrame) -> DataFrame:
    return with_stage(finished_games(games)).filter(F.col("stage").isNotNull())


def _team_sides(games: DataFrame, *extra: str) -> DataFrame:
    """Two rows per game, one for each team."""

    def side(own: str, other: str, home: int):
        return F.struct(
            F.col(f"{own}_team_id").alias("team_id"),
            blank_to_null(_optional(games, f"{own}_team_abbr_raw")).alias("team_abbr"),
            F.col(f"{own}_score").alias("scored"),
            F.col(f"{other}_score").alias("allowed"),
            F.lit(home).alias("is_home"),
        )

    competition = F.coalesce(blank_to_null(_optional(games, "competition")), F.lit(DEFAULT_COMPETITION))
    return games.filter(F.col("season_id").isNotNull()).select(
        "season_id", competition.alias("competition"), *extra,
        F.inline(F.array(side("home", "away", 1), side("away", "home", 0))),
    )


def _count(condition):
    return F.sum(condition.cast("bigint"))


def _regular_sums(regular=None) -> list:
    """Sums of one team's games, counting only those that are ``regular``."""
    regular = F.lit(True) if regular is None else regular
    won, home = F.col("scored") > F.col("allowed"), F.col("is_home") == 1
    points = lambda c: F.sum(F.when(regular, F.col(c)).otherwise(0))
    return [
        _count(regular).alias("games_played"), _count(regular & won).alias("wins"),
        _count(regular & home & won).alias("home_wins"), _count(regular & home & ~won).alias("home_losses"),
        _count(regular & ~home & won).alias("away_wins"), _count(regular & ~home & ~won).alias("away_losses"),
        points("scored").alias("points_for"), points("allowed").alias("points_against"),
    ]


SUMMED = ("games_played", "wins", "home_wins", "home_losses", "away_wins", "away_losses", "points_for", "points_against")


def _over_abbreviations(by_abbr: DataFrame, *more) -> DataFrame:
    """Totals per team with the most frequent abbreviation (the smallest on a tie)."""
    counted = F.col("team_abbr").isNotNull() & (F.col("games_played") > 0)
    most_used = F.min(F.when(counted, F.struct((-F.col("games_played")).alias("n"), "team_abbr")))
    return (
        by_abbr.groupBy(*TABLE_KEY)
        .agg(*[F.sum(c).alias(c) for c in SUMMED], most_used.getField("team_abbr").alias("team_abbr"), *more)
        .withColumn("losses", F.col("games_played") - F.col("wins"))
        .withColumn("point_diff", F.col("points_for") - F.col("points_against"))
    )


def regular_season_table(games: DataFrame) -> DataFrame:
    """Wins, losses and points per team; equal scores count as a loss for both.

    Aggregated first by abbreviation as well, so the most frequent abbreviation
    falls out of the second, small aggregation.
    """
    sides = _team_sides(regular_season_games(games))
    return _over_abbreviations(sides.groupBy(*TABLE_KEY, "team_abbr").agg(*_regular_sums()))


def season_champion(games: DataFrame) -> DataFrame:
    """The team with most final wins, where no other team has as many."""
    competition = F.coalesce(blank_to_null(_optional(games, "competition")), F.lit(DEFAULT_COMPETITION))
    stored = blank_to_null("winner_team_id").cast("bigint") if "winner_team_id" in games.columns else None
    finals = (
        with_stage(finished_games(games)).filter((F.col("stage") == "final") & F.col("season_id").isNotNull())
        .select("season_id", competition.alias("competition"),
                winner("home_team_id", "away_team_id", "home_score", "away_score", stored).alias("team_id"))
        .filter(F.col("team_id").isNotNull())
    )
    wins = finals.groupBy(*TABLE_KEY).agg(F.count("*").alias("final_wins"))
    per_level = wins.groupBy("season_id", "competition", "final_wins").agg(
        F.count("*").alias("teams"), F.min("team_id").alias("team_id")
    )
    best = per_level.groupBy("season_id", "competition").agg(
        F.max_by(F.struct("teams", "team_id", "final_wins"), "final_wins").alias("top")
    )
    return best.filter(F.col("top.teams") == 1).select(
        "season_id", "competition", F.col("top.team_id"), F.col("top.final_wins")
    )


def postseason_finish(games: DataFrame) -> DataFrame:
    """Highest stage each team reached; the champion is raised above the runner-up."""
    reached = _team_sides(postseason_games(games), "stage").groupBy(*TABLE_KEY).agg(
        F.max(stage_order("stage")).alias("reached")
    )
    champions = season_champion(games).select(*TABLE_KEY, F.lit(True).alias("won"))
    order = F.when(F.col("won"), F.lit(STAGES["campeao"][0]).cast("bigint")).otherwise(F.col("reached"))
    return reached.join(champions, TABLE_KEY, "full").select(
        *TABLE_KEY, order.alias("finish_stage_order"), stage_label(order).alias("finish_stage")
    )


def standings_rank(table: DataFrame) -> DataFrame:
    """Place in the table: win ratio, wins, point difference, points, name, team.

    Numbers teams of one season and competition, i.e. rows that are already one
    per team.
    """
    ratio = F.when(F.col("games_played") > 0, F.col("wins") / F.col("games_played")).otherwise(0.0)
    window = Window.partitionBy("season_id", "competition").orderBy(
        ratio.desc(), F.desc("wins"), F.desc("point_diff"), F.desc("points_for"),
        F.coalesce("team_name", F.lit("")), "team_id",
    )
    return table.withColumn("rank", F.row_number().over(window).cast("bigint"))


def team_names(teams: DataFrame) -> DataFrame:
    """(team_id, team_name): the canonical name, else the plain one."""
    present = [c for c in ("canonical_name", "name") if c in teams.columns]
    return teams.select(
        F.col("id").alias("team_id"), F.coalesce(*[blank_to_null(c) for c in present]).alias("team_name")
    )


def _table_with_finish(games: DataFrame) -> DataFrame:
    """``regular_season_table`` and ``postseason_finish`` from one pass over the games."""
    staged = with_stage(finished_games(games))
    stored = [F.col("winner_team_id")] if "winner_team_id" in games.columns else []
    won_by = winner("home_team_id", "away_team_id", "home_score", "away_score", *stored)
    sides = _team_sides(staged.withColumn("won_by", won_by), "stage", "won_by")
    final_win = (F.col("stage") == "final") & (F.col("won_by") == F.col("team_id"))
    by_abbr = sides.groupBy(*TABLE_KEY, "team_abbr").agg(
        *_regular_sums(F.col("stage").isNull()), F.max(stage_order("stage")).alias("reached"),
        F.count_if(final_win).alias("final_wins"),
    )
    table = _over_abbreviations(by_abbr, F.max("reached").alias("reached"), F.sum("final_wins").alias("final_wins"))
    # teams of one season and competition, one row each
    season = Window.partitionBy("season_id", "competition")
    level = Window.partitionBy("season_id", "competition", "final_wins")
    champion = (
        (F.col("final_wins") > 0) & (F.col("final_wins") == F.max("final_wins").over(season))
        & (F.count("*").over(level) == 1)
    )
    order = F.when(champion, F.lit(STAGES["campeao"][0]).cast("bigint")).otherwise(F.col("reached"))
    return table.withColumn("finish_stage_order", order).filter("games_played > 0")


def standings(games: DataFrame, teams: DataFrame, seasons: DataFrame) -> DataFrame:
    """One row per season, competition and team, with place and final stage."""
    table = (
        _table_with_finish(games)
        .join(team_names(teams), "team_id", "left")
        .join(seasons.select(F.col("id").alias("season_id"), F.col("name").alias("season_name"),
                             F.col("is_current").cast("bigint").alias("is_current")), "season_id", "left")
    )
    missing = F.when(F.col("is_current") == 1, F.lit(IN_PROGRESS_ORDER)).otherwise(0)
    order = F.coalesce(F.col("finish_stage_order"), missing.cast("bigint"))
    return (
        standings_rank(table)
        .withColumn("finish_stage_order", order)
        .select(
            "season_id", "season_name", "competition", "rank", "team_id", "team_name", "team_abbr",
            win_pct("wins", "games_played").alias("ap_pct"), "games_played", "wins", "losses",
            record_text("home_wins", "home_losses").alias("home_record"),
            record_text("away_wins", "away_losses").alias("away_record"),
            "home_wins", "home_losses", "away_wins", "away_losses",
            "points_for", "points_against", "point_diff",
            (F.col("finish_stage_order") > 0).cast("bigint").alias("qualified_playoffs"),
            stage_label("finish_stage_order").alias("finish_stage"),
            "finish_stage_order",
            (F.col("finish_stage_order") == STAGES["campeao"][0]).cast("bigint").alias("is_champion"),
        )
    )
