"""Best single games of a player, over a career and within each season."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import RECORD_STATS
from ..functions.games import side_and_opponent
from ..functions.stats import to_float
from .rollups import with_names
from .standings import team_names


def player_records(stats: DataFrame, games: DataFrame, players: DataFrame, teams: DataFrame,
                   seasons: DataFrame) -> DataFrame:
    """Highest value, how often it was reached, and the latest game that shows it.

    First the highest values per player and season, plain maxima in one hash aggregate; then
    only the lines that reach one of them go on, a row per value reached.  A career's best
    lines are among the best of their seasons (lines without season are a season of their
    own here), so the career scope is read from those few rows.
    """
    numeric = dict(stats.dtypes)
    value = lambda s: to_float(s) if numeric[s] == "string" else F.coalesce(F.col(s).cast("double"), F.lit(0.0))
    kinds = [s for s, _ in RECORD_STATS]
    lines = stats.filter(F.col("player_id").isNotNull()).select("player_id", "season_id", "game_id", "team_id", *[value(s).alias(s) for s in kinds])
    highest = lines.groupBy(F.col("player_id").alias("h_player"), F.col("season_id").alias("h_season")).agg(*[F.max(s).alias(f"h_{s}") for s in kinds])
    meets = (F.col("player_id") == F.col("h_player")) & F.col("season_id").eqNullSafe(F.col("h_season"))
    reached = F.filter(F.array(*[F.when(F.col(s) == F.col(f"h_{s}"), F.struct(F.lit(s).alias("record_type"), F.col(s).alias("value"))) for s in kinds]),
                       lambda r: r.isNotNull())
    shown = lines.join(highest, meets).select("player_id", "season_id", "game_id", "team_id", reached.alias("reached")).filter(F.size("reached") > 0)
    dated = shown.join(games.select(F.col("id").alias("game_id"), "game_date"), "game_id", "left")
    game = F.struct("game_date", "game_id", "team_id")
    per_season = dated.select("player_id", "season_id", game.alias("game"), F.inline("reached")) \
        .groupBy("player_id", "season_id", "record_type", "value").agg(F.count("*").alias("n"), F.max("game").alias("game"))

    scopes = F.array(
        F.struct(F.lit("career").alias("scope"), F.lit(None).cast("bigint").alias("scope_season")),
        F.struct(F.lit("season").alias("scope"), F.col("season_id").cast("bigint").alias("scope_season")),
    )
    scoped = per_season.select("player_id", "record_type", "value", "n", "game", F.inline(scopes)) \
        .filter((F.col("scope") == "career") | F.col("scope_season").isNotNull()) \
        .groupBy("player_id", "scope", "scope_season", "record_type", "value") \
        .agg(F.sum("n").alias("n"), F.max("game").alias("game"))
    best = scoped.groupBy("player_id", "scope", "scope_season", "record_type").agg(
        F.max(F.struct("value", "n", "game")).alias("best")
    )

    labels = F.create_map(*[F.lit(x) for pair in RECORD_STATS for x in pair])
    chosen = best.select(
        "player_id", "scope", F.col("scope_season").alias("season_id"), "record_type",
        labels[F.col("record_type")].alias("record_label"),
        F.col("best.value").alias("value"), F.col("best.n").alias("tie_count"),
        F.col("best.game.game_id").alias("game_id"), F.col("best.game.game_date").alias("game_date"),
        F.col("best.game.team_id").alias("team_id"),
    )
    # scores and sides are looked up for the chosen games only
    sides = games.select(F.col("id").alias("game_id"), "home_team_id", "away_team_id", "home_score", "away_score")
    view = side_and_opponent("team_id", "home_team_id", "away_team_id", "home_score", "away_score")
    rows = chosen.join(sides, "game_id", "left").select(*chosen.columns, view.alias("view")).select(
        *chosen.columns, "view.*"
    )
    opponents = team_names(teams).select(
        F.col("team_id").alias("opponent_team_id"), F.col("team_name").alias("opponent_team_name")
    )
    return with_names(rows, players, teams, seasons).join(opponents, "opponent_team_id", "left")
