"""Season and career rollups of player and team lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_COMPETITION, KEEPS_NAME, MINUTES, PER_GAME, SHORT_TOTALS, SHOTS, STAT_INPUTS
from ..functions.stats import per_game, season_pct, to_bool, to_float
from ..functions.text import blank_to_null, clean_text
from .standings import team_names

PLAYER_SEASON_TEAM = ["season_id", "team_id", "player_id"]


def total_name(stat: str) -> str:
    if stat in KEEPS_NAME:
        return stat
    return SHORT_TOTALS.get(stat, f"{stat}_total")


PLAYER_TOTALS = [total_name(s) for s in (MINUTES, *STAT_INPUTS)]
TEAM_TOTALS = [total_name(s) for s in STAT_INPUTS]


def _summed(df: DataFrame, stat: str) -> Column:
    """Sum of a statistic; text columns are read leniently, blanks count as 0."""
    if dict(df.dtypes)[stat] == "string":
        return F.sum(to_float(stat)).alias(total_name(stat))
    return F.coalesce(F.sum(stat), F.lit(0)).alias(total_name(stat))


def with_ratios(df: DataFrame, games: str = "games_played") -> DataFrame:
    """Per-game means and shooting ratios for whatever totals a rollup has."""
    means = {f"{s}_per_game": per_game(f"{s}_total", games) for s in PER_GAME if f"{s}_total" in df.columns}
    ratios = {f"{s}_pct": season_pct(f"{s}_made", f"{s}_attempted") for s in SHOTS}
    return df.withColumns(means | ratios)


def with_names(df: DataFrame, players: DataFrame | None = None, teams: DataFrame | None = None,
               seasons: DataFrame | None = None) -> DataFrame:
    """Left-join the names of players, teams and seasons onto facts or rollups.

    No broadcast is forced: dimensions below the session's threshold are broadcast
    by the planner, larger ones are shuffled.
    """
    if players is not None:
        names = players.select(
            F.col("id").alias("player_id"),
            F.coalesce(clean_text("full_name"), clean_text("display_name")).alias("player_name"),
        )
        df = df.join(names, "player_id", "left")
    if teams is not None:
        df = df.join(team_names(teams), "team_id", "left")
    if seasons is not None:
        df = df.join(
            seasons.select(F.col("id").alias("season_id"), clean_text("name").alias("season_name")),
            "season_id", "left",
        )
    return df


def resolved_rows(stats: DataFrame) -> DataFrame:
    return stats.filter(
        F.col("player_id").isNotNull() & F.col("team_id").isNotNull() & F.col("season_id").isNotNull()
    )


def most_common(df: DataFrame, keys: list[str], column: str, name: str | None = None) -> DataFrame:
    """Most frequent non-blank value per key; the smallest one on a tie.

    Counted per (key, value) first, so a large key is spread over its values.
    """
    value = clean_text(column)
    counts = df.select(*keys, value.alias("__value")).filter("__value IS NOT NULL") \
        .groupBy(*keys, "__value").agg(F.count("*").alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col("__value").alias("value")))
    return counts.groupBy(*keys).agg(best.getField("value").alias(name or column))


def player_team_seasons(stats: DataFrame, players: DataFrame, teams: DataFrame,
                        seasons: DataFrame, tasks: int | None = None) -> DataFrame:
    """Totals and means per season, team and player, in one pass over the lines.

    Games are counted distinct (a repeated line adds to the totals, not to the
    games).  A player without a name gets the most frequent name on the lines, the
    smallest on a tie: lines of such players enter the aggregate a second time under their name.

    With ``tasks``, the lines are dealt by player over so many tasks, in which this rollup and those
    made from it by player go on without another shuffle of the lines.
    """
    rows = resolved_rows(stats)
    if tasks:
        rows = rows.repartition(tasks, "player_id")
    if "player_name_raw" in stats.columns:
        own = F.coalesce(clean_text("full_name"), clean_text("display_name"))
        known = players.filter(own.isNotNull()).select(F.col("id").alias("player_id"), F.lit(True).alias("__known")).distinct()
        raw = F.when(F.col("__known").isNull(), clean_text("player_name_raw"))
        rows = rows.join(known, "player_id", "left").withColumn("__raw", raw)
        rows = rows.select("*", F.explode(F.when(F.col("__raw").isNull(), F.array(F.lit(None).cast("string"))).otherwise(
            F.array(F.lit(None).cast("string"), F.col("__raw")))).alias("__name"))
    else:
        rows = rows.withColumn("__name", F.lit(None).cast("string"))
    totals = rows.groupBy(*PLAYER_SEASON_TEAM, "__name").agg(
        F.count_distinct("game_id").alias("games_played"), F.count("*").alias("__lines"),
        F.sum(to_bool("is_starter").cast("bigint")).alias("games_started"),
        *[_summed(rows, s) for s in (MINUTES, *STAT_INPUTS)],
    )
    # the row of all lines comes first, the most frequent name next
    order = Window.partitionBy(*PLAYER_SEASON_TEAM).orderBy(F.col("__name").isNotNull(), F.desc("__lines"), "__name")
    totals = totals.withColumn("raw_name", F.lead("__name").over(order)).filter("__name IS NULL").drop("__name", "__lines")
    named = with_names(totals, players, teams, seasons)
    return with_ratios(named.withColumn("player_name", F.coalesce("player_name", "raw_name")).drop("raw_name"))


def skipped_rows(stats: DataFrame) -> DataFrame:
    """How many lines the rollup leaves out, by the first reason that applies."""
    reason = (
        F.when(F.col("player_id").isNull(), "missing_player_id")
        .when(F.col("team_id").isNull(), "missing_team_id")
        .when(F.col("season_id").isNull(), "missing_season_id")
    )
    return stats.select(reason.alias("reason")).filter("reason IS NOT NULL") \
        .groupBy("reason").agg(F.count("*").alias("rows"))


def ordered_ids(df: DataFrame, keys: list[str], order: Column, value: str) -> DataFrame:
    """Distinct values per key in order of first appearance, joined by a pipe.

    Values are first reduced to one row each with their earliest position.
    """
    firsts = df.groupBy(*keys, value).agg(F.min(order).alias("__at"))
    listed = F.array_sort(F.collect_list(F.struct("__at", value)))
    return firsts.groupBy(*keys).agg(
        F.array_join(F.transform(listed, lambda s: s[value].cast("string")), "|").alias(f"{value}s"),
        F.count("*").alias("teams_count"),
    )


def _over_teams(by_team: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of a key, its seasons, and its teams in order of (first season, team id), in one pass.

    A key has one row per team when it meets the others, so its lists are as long as its teams and seasons.
    """
    sums = [F.sum(c).alias(c) for c in ("games_played", "games_started", *PLAYER_TOTALS)]
    names = [F.min(c).alias(c) for c in ("player_name", "season_name", "team_name")]
    per_team = by_team.withColumn("__season", F.col("season_id")).groupBy(*keys, "team_id").agg(
        F.min("__season").alias("first_season_id"), F.max("__season").alias("last_season_id"),
        F.collect_set("__season").alias("__seasons"), *names, *sums)
    team = F.struct(F.col("first_season_id").alias("first"), "team_id", "team_name", F.col("games_played").alias("games"))
    rows = per_team.groupBy(*keys).agg(
        F.min("first_season_id").alias("first_season_id"), F.max("last_season_id").alias("last_season_id"),
        F.size(F.array_distinct(F.flatten(F.collect_list("__seasons")))).cast("bigint").alias("seasons_count"),
        F.min("player_name").alias("player_name"), F.min("season_name").alias("season_name"), *sums,
        F.array_sort(F.collect_list(team)).alias("__teams"))
    listed = F.filter(F.transform("__teams", lambda t: t["team_name"]), lambda n: n.isNotNull())
    most = F.array_max(F.transform("__teams", lambda t: F.struct(t["games"], (-t["team_id"]).alias("less"), t["team_name"].alias("name"))))
    return rows.withColumns({
        "teams_count": F.size("__teams").cast("bigint"),
        "team_ids": F.array_join(F.transform("__teams", lambda t: t["team_id"].cast("string")), "|"),
        "team_names": F.array_join(listed, "|"), "__most": most,
    }).withColumns({"primary_team_id": -F.col("__most.less"), "primary_team_name": F.col("__most.name")}).drop("__teams", "__most")


def player_seasons(by_team: DataFrame) -> DataFrame:
    """Season totals of a player over all teams, from ``player_team_seasons``, which is read once."""
    rows = _over_teams(by_team, ["season_id", "player_id"]).drop("first_season_id", "last_season_id", "seasons_count")
    return with_ratios(rows)


def player_career_totals(by_team: DataFrame, seasons: DataFrame) -> DataFrame:
    """Career totals of a player, from ``player_team_seasons``, which is read once."""
    totals = _over_teams(by_team, ["player_id"]).drop("season_name", "primary_team_id", "primary_team_name")
    label = seasons.select("id", clean_text("name").alias("name"))
    first = label.select(F.col("id").alias("first_season_id"), F.col("name").alias("first_season_name"))
    last = label.select(F.col("id").alias("last_season_id"), F.col("name").alias("last_season_name"))
    return with_ratios(totals.join(first, "first_season_id", "left").join(last, "last_season_id", "left"))


def team_seasons(team_stats: DataFrame, standings: DataFrame, teams: DataFrame, seasons: DataFrame) -> DataFrame:
    """Season totals of a team, completed with its line in the standings."""
    keys = ["season_id", "competition", "team_id"]
    rows = team_stats.filter(F.col("season_id").isNotNull() & F.col("team_id").isNotNull()).withColumn(
        "competition", F.coalesce(blank_to_null("competition"), F.lit(DEFAULT_COMPETITION))
    )
    totals = rows.groupBy(*keys).agg(
        F.count_distinct("game_id").alias("games_played"), *[_summed(rows, s) for s in STAT_INPUTS]
    )
    place = standings.select(
        "season_id", F.coalesce(blank_to_null("competition"), F.lit(DEFAULT_COMPETITION)).alias("competition"),
        "team_id", "rank", "ap_pct", "wins", "losses", "home_record", "away_record", "finish_stage",
        "is_champion", "points_against", "point_diff",
    )
    joined = totals.join(place, keys, "left")
    return with_ratios(with_names(joined, teams=teams, seasons=seasons))


def team_game_stats(stats: DataFrame) -> DataFrame:
    """Team lines summed from the player lines of the same game."""
    rows = stats.filter(F.col("team_id").isNotNull())
    return rows.groupBy("game_id", "season_id", "competition", "team_id", "opponent_team_id").agg(
        *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in STAT_INPUTS]
    )


def career_averages(by_season: DataFrame) -> DataFrame:
    """Career means weighted by games; a missing total is rebuilt from the mean."""
    stats = ("minutes", "points", "rebounds", "assists", "steals", "blocks", "turnovers", "efficiency")
    games = F.col("games_played")

    def mean(stat: str) -> Column:
        total = F.coalesce(F.col(f"{stat}_total"), F.col(f"{stat}_per_game") * games, F.lit(0))
        return F.when(F.sum(games) > 0, F.sum(total) / F.sum(games)).alias(f"{stat}_avg")

    return by_season.groupBy("player_id").agg(
        F.sum(games).alias("games_played"), *[mean(s) for s in stats]
    )


def season_averages(df: DataFrame, keys: list[str], games: Column) -> DataFrame:
    """Every total divided by games; NULL when there are none."""
    totals = [c for c in PLAYER_TOTALS if c in df.columns]
    return df.select(
        *keys, games.alias("games"),
        *[F.when(games > 0, F.col(c) / games).alias(f"{c}_avg") for c in totals],
    )
