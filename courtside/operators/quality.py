"""Data-quality reports: duplicates, missing keys, statuses, totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..constants import REQUIRED_TABLES
from ..sources.tables import table_counts


def count_by(df: DataFrame, *columns: str, name: str = "rows") -> DataFrame:
    """Frequencies, most frequent first."""
    return df.groupBy(*columns).agg(F.count("*").alias(name)).orderBy(F.desc(name), *columns)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def key_diff(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, tagged missing (expected only) or extra.

    One aggregation over both sides instead of two anti-joins; a repeated key is
    reduced on the map side.
    """
    both = expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("a")).unionAll(
        actual.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("a"))
    )
    sides = both.groupBy(*keys).agg(F.max("e").alias("e"), F.max("a").alias("a"))
    return sides.filter(F.col("e") != F.col("a")).select(
        *keys, F.when(F.col("e") == 1, "missing").otherwise("extra").alias("side")
    )


def empty_required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which a required column is NULL or blank."""
    return df.filter(reduce(lambda a, b: a | b, [blank_to_null(c).isNull() for c in columns]))


def _rows(df: DataFrame, check: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).select(F.lit(check).alias("check"), "rows")


def check_player_team_seasons(stats: DataFrame, rollup: DataFrame, tasks: int | None = None) -> DataFrame:
    """Counts for the player rollup, and 1/0 under ``ok``; lines and rollup are read once each.

    Both sides are counted per key in one aggregate, and every check is a sum over its keys.
    With ``tasks``, their keys are dealt over so many.
    """
    keys = ["season_id", "team_id", "player_id"]
    lines = stats.dropna(subset=keys).select(*keys, F.lit(1).alias("e"), F.lit(0).alias("a"))
    both = lines.unionByName(rollup.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("a")))
    if tasks:
        both = both.repartition(tasks, *keys)
    counts = both.groupBy(*keys).agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    blank = reduce(lambda x, y: x | y, [blank_to_null(c).isNull() for c in keys])
    expected, there = F.col("e") > 0, F.col("a") > 0
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    checks = {
        "resolved_lines": number(F.sum("e")), "expected_groups": F.count_if(expected), "rollup_rows": number(F.sum("a")),
        "duplicates": F.count_if(F.col("a") > 1), "missing": F.count_if(expected & ~there), "extra": F.count_if(there & ~expected),
        "empty_required": number(F.sum(F.when(blank, F.col("a")))),
    }
    one = counts.agg(*[c.alias(name) for name, c in checks.items()])
    clean = reduce(lambda x, y: x & y, [F.col(c) == 0 for c in ("duplicates", "missing", "extra", "empty_required")])
    one = one.withColumn("ok", (clean & (F.col("expected_groups") == F.col("rollup_rows"))).cast("bigint"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("rows")) for c in one.columns])))


def check_standings(standings: DataFrame) -> DataFrame:
    """Per season and competition: teams, champions, stages and bad rows."""
    blank = lambda c: blank_to_null(c).isNull()
    bad = blank("season_id") | blank("team_id") | blank("rank")
    per_key = standings.groupBy("season_id", "competition", "team_id").agg(
        F.count("*").alias("rows"),
        F.sum(bad.cast("bigint")).alias("empty_required"),
        F.max("is_champion").alias("is_champion"),
        F.max("finish_stage").alias("finish_stage"),
        F.max("team_name").alias("team_name"),
    )
    stages = {"semifinal": "semifinalists", "vice-campeão": "runners_up", "não classificou": "not_qualified"}
    return per_key.groupBy("season_id", "competition").agg(
        F.count("*").alias("teams"),
        F.sum("rows").alias("rows"),
        F.sum((F.col("rows") > 1).cast("bigint")).alias("duplicates"),
        F.sum("empty_required").alias("empty_required"),
        F.sum("is_champion").alias("champions"),
        F.min(F.when(F.col("is_champion") == 1, F.col("team_name"))).alias("champion_name"),
        *[F.sum((F.col("finish_stage") == label).cast("bigint")).alias(name) for label, name in stages.items()],
    )


# --- boxscore coverage ------------------------------------------------------------------


def _coverage(games: DataFrame, player_stats: DataFrame, team_stats: DataFrame, failed: DataFrame) -> DataFrame:
    """Games with their number of player and team lines and their failure, if any."""
    lines = lambda df, name: df.filter(F.col("game_id").isNotNull()).groupBy("game_id").agg(F.count("*").alias(name))
    failure = failed.groupBy("game_id").agg(
        F.max_by(F.struct("error_type", "error_message"), "id").alias("failure")
    )
    zero = F.lit(0).cast("bigint")
    return (
        games.withColumnRenamed("id", "game_id")
        .join(lines(player_stats, "player_rows"), "game_id", "left")
        .join(lines(team_stats, "team_rows"), "game_id", "left")
        .join(failure, "game_id", "left")
        .withColumn("player_rows", F.coalesce("player_rows", zero))
        .withColumn("team_rows", F.coalesce("team_rows", zero))
    )


def _complete() -> Column:
    return (F.col("player_rows") > 0) & (F.col("team_rows") == 2)


def boxscore_status(games: DataFrame, player_stats: DataFrame, team_stats: DataFrame,
                    failed: DataFrame) -> DataFrame:
    """success / failed / no_boxscore_url / unknown for every game."""
    rows = _coverage(games, player_stats, team_stats, failed)
    has_failure, has_url = F.col("failure").isNotNull(), blank_to_null("boxscore_url").isNotNull()

    def pick(success, failure, no_url, unknown) -> Column:
        return F.when(_complete(), success).when(has_failure, failure).when(~has_url, no_url).otherwise(unknown)

    none = F.lit(None).cast("string")
    return rows.select(
        "game_id", "season_id", "competition", "game_date", "home_score", "away_score", "boxscore_url",
        pick(F.lit("success"), F.lit("failed"), F.lit("no_boxscore_url"), F.lit("unknown")).alias("status"),
        _complete().cast("bigint").alias("has_boxscore_stats"),
        F.col("team_rows").alias("team_game_stats_rows"),
        (F.col("player_rows") > 0).cast("bigint").alias("has_player_game_stats"),
        pick(none, F.col("failure.error_type"), F.lit("missing_boxscore_url"),
             F.lit("not_processed_or_inconsistent")).alias("error_type"),
        pick(none, F.col("failure.error_message"), none, none).alias("error_message"),
    )


def boxscore_status_report(status: DataFrame) -> DataFrame:
    return count_by(status, "status", name="games")


def boxscore_unknowns(games: DataFrame, player_stats: DataFrame, team_stats: DataFrame,
                      failed: DataFrame) -> DataFrame:
    """Games with an address that neither failed nor loaded completely."""
    rows = _coverage(games, player_stats, team_stats, failed)
    return rows.filter(
        blank_to_null("boxscore_url").isNotNull() & F.col("failure").isNull() & ~_complete()
    ).select("game_id", "season_id", "game_date", "home_score", "away_score", "player_rows", "team_rows", "boxscore_url")


def only_failed(games: DataFrame, failed: DataFrame) -> DataFrame:
    return games.join(failed.select(F.col("game_id").alias("id")), "id", "left_semi")


def team_only_games(player_stats: DataFrame, team_stats: DataFrame) -> DataFrame:
    """Games with team lines but not a single player line."""
    teams = team_stats.filter("game_id IS NOT NULL").groupBy("game_id").agg(F.count("*").alias("team_rows"))
    return teams.join(player_stats.select("game_id"), "game_id", "left_anti")


def incomplete_team_stats(games: DataFrame, player_stats: DataFrame, team_stats: DataFrame) -> DataFrame:
    """Games with player lines whose number of team lines is not two."""
    played = player_stats.filter("game_id IS NOT NULL").select("game_id").distinct()
    lines = team_stats.groupBy("game_id").agg(F.count("*").alias("n"))
    counted = played.join(lines, "game_id", "left").select("game_id", F.coalesce("n", F.lit(0)).alias("team_stats_rows"))
    return counted.filter(F.col("team_stats_rows") != 2).join(
        games.select(F.col("id").alias("game_id"), "season_id", "home_team_id", "away_team_id", "boxscore_url"),
        "game_id", "left",
    )


def check_boxscores(games: DataFrame, player_stats: DataFrame, team_stats: DataFrame, failed: DataFrame,
                    unresolved: DataFrame) -> DataFrame:
    """Totals, failures by type, unresolved lines by reason, incomplete games."""
    totals = [
        _rows(games, "games"), _rows(player_stats, "player_lines"), _rows(team_stats, "team_lines"),
        _rows(failed, "failed"), _rows(unresolved, "unresolved"),
        _rows(incomplete_team_stats(games, player_stats, team_stats), "incomplete_team_stats"),
    ]
    parts = [t.select(F.lit("total").alias("section"), F.col("check").alias("item"), "rows") for t in totals]
    parts.append(count_by(failed, "error_type").select(F.lit("failed_by_type").alias("section"), F.col("error_type").alias("item"), "rows"))
    parts.append(count_by(unresolved, "reason").select(F.lit("unresolved_by_reason").alias("section"), F.col("reason").alias("item"), "rows"))
    return reduce(DataFrame.unionByName, parts)


def validate_core_tables(tables: dict[str, DataFrame], spark) -> DataFrame:
    """Every registered table with its row count and whether that is acceptable."""
    state = F.when(F.col("rows") < 0, "missing").when(
        (F.col("rows") == 0) & F.col("table_name").isin(*REQUIRED_TABLES), "empty"
    ).otherwise("ok")
    return table_counts(tables, spark).withColumn("state", state)
