"""Keyed upserts of facts and dimensions, and the queues kept beside them.

Every merge returns the whole new table with a ``change`` column (inserted, updated,
unchanged).  Incoming rows are first reduced to one per key, on the map side, so
many copies of one row cost nothing in the join.  New rows have no id; ids are
given at the end, by ``assign_ids``.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.games import team_ids_for_side, winner
from ..functions.text import blank_to_null, clean_text, identity_key, iso_date, slugify
from ..session import computed, cut_lineage
from .extract import is_dnp
from .positions import with_surrogate_id
from .quality import team_only_games
from .resolve import name_records, resolve_players, resolve_team


def _key(expressions: list[Column]) -> Column:
    """A key as one text, blanks included, so that it joins by plain equality."""
    return F.concat_ws("\x1f", *[F.coalesce(e.cast("string"), F.lit("")) for e in expressions])


def _key_or_null(expressions: list[Column]) -> Column:
    """The key, or null where all its parts are blank: such a row is equal to no other."""
    return F.when(blank_to_null(F.concat_ws("", *expressions)).isNotNull(), _key(expressions))


def latest_per_key(df: DataFrame, key: list[Column], order: list) -> DataFrame:
    """The last row of each key in the stated order, as the last write would win.

    Rows that agree in the order are told apart by all their values.
    """
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], F.struct(*df.columns))
    return df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), rank).alias("row")).select("__key", "row.*")


def upsert(current: DataFrame, incoming: DataFrame, key, order: list, keep_old_if_blank: bool = False,
           combine: dict[str, str] | None = None) -> DataFrame:
    """Insert or overwrite by key.

    ``key`` builds the key expressions of either side.  ``keep_old_if_blank`` lets
    only non-blank values overwrite.  ``combine`` names columns merged by ``least``
    or ``greatest`` instead of being overwritten.

    Columns that ``incoming`` lacks keep their old value and are no change.  Rows whose
    key parts are all blank have no key: stored ones stay as they are, incoming ones are
    inserted, equal ones once.
    """
    combine = combine or {}
    fields = [c for c in current.columns if c != "id"]
    new = incoming.select(*[F.col(c) if c in incoming.columns else F.lit(None).alias(c) for c in fields], *[
        c for c in order if isinstance(c, str) and c not in fields])
    # rows without key are told apart by their values
    own = F.when(_key_or_null(key(new)).isNull(), F.struct(*[c for c in fields if c in incoming.columns]))
    grouped = [_key_or_null(key(new)).alias("__key"), own.alias("__own")]
    if keep_old_if_blank or combine:
        ordered = [F.col(c) if isinstance(c, str) else c for c in order]
        values = []
        for c in fields:
            if c in combine:
                values.append((F.min if combine[c] == "least" else F.max)(c).alias(c))
            else:
                present = blank_to_null(c).isNotNull()
                values.append(F.max_by(F.when(present, F.col(c)), F.when(present, F.struct(*ordered, F.col(c)))).alias(c))
        new = new.groupBy(*grouped).agg(*values)
    else:
        new = latest_per_key(new, grouped, order).select("__key", *fields)

    # a null key meets nothing; a hash of the row keeps such rows from gathering in one task
    apart = F.when(F.col("__key").isNull(), F.xxhash64(*[c for c in fields if c in incoming.columns])).otherwise(F.lit(0))
    old = current.withColumns({"__key": _key_or_null(key(current)), "__there": F.lit(1)}).withColumn("__apart", apart)
    new = new.withColumn("__there", F.lit(1)).withColumn("__apart", apart)
    joined = old.alias("o").join(new.alias("n"), ["__key", "__apart"], "full")
    was, now = F.col("o.__there").isNotNull(), F.col("n.__there").isNotNull()

    def merged(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c not in incoming.columns:
            return o
        if c in combine:
            return F.least(o, n) if combine[c] == "least" else F.greatest(o, n)
        if keep_old_if_blank:
            return F.when(blank_to_null(n).isNotNull(), n).otherwise(o)
        return F.when(now, n).otherwise(o)

    differs = reduce(lambda a, b: a | b, [~merged(c).eqNullSafe(F.col(f"o.{c}")) for c in fields])
    change = F.when(~was, "inserted").when(now & differs, "updated").otherwise("unchanged")
    ids = [F.col("o.id").alias("id")] if "id" in current.columns else []
    return joined.select(*ids, *[merged(c).alias(c) for c in fields], change.alias("change"))


def upsert_partitions(spark: SparkSession, path: str, incoming: DataFrame, key, order: list, partition: str = "season_id",
                      moves: bool = True, **options) -> DataFrame:
    """Upsert into a Parquet table partitioned by one column; only partitions that the run touches are rewritten.

    Touched are the partitions of ``incoming`` and, where a row may move to another partition
    (``moves``), those in which its key is stored; they are found from the key columns alone.
    The partition list, not the rows, passes through the driver.  Files of other partitions keep their
    names.  Returns the merged rows of the touched partitions with ``change``, read from the scratch
    folder; a job that fails before these are complete leaves the table as it was.
    """
    stored = spark.read.parquet(path)
    kind = stored.schema[partition].dataType
    incoming = cut_lineage(incoming.withColumn(partition, F.col(partition).cast(kind)), "incoming")
    touched = incoming.select(partition).distinct()
    if moves:
        keys = incoming.select(_key_or_null(key(incoming)).alias("__key")).dropna().distinct()
        found = stored.withColumn("__key", _key_or_null(key(stored))).join(keys, "__key", "left_semi")
        touched = touched.union(found.select(partition)).distinct()
    values = [row[0] for row in touched.collect()]
    named = F.col(partition).isin([v for v in values if v is not None])
    wanted = (named | F.col(partition).isNull()) if None in values else named
    merged = cut_lineage(upsert(stored.filter(wanted), incoming, key, order, **options), "merged")
    left = [row[0] for row in merged.select(partition).distinct().collect()]
    merged.drop("change").select(*stored.columns).repartition(partition, F.xxhash64(*stored.columns) % 8).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    _drop_partitions(spark, path, partition, [v for v in values if v not in left])
    return merged


def _drop_partitions(spark: SparkSession, path: str, partition: str, values: list) -> None:
    """Delete the folders of partitions that have no rows any more (writing replaces only those that have)."""
    for value in values:
        name = "__HIVE_DEFAULT_PARTITION__" if value is None else quote(str(value), safe=" .-_")
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{partition}={name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def change_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("change").agg(F.count("*").alias("rows"))


def assign_ids(merged: DataFrame, order: list) -> DataFrame:
    """Continue the ids: new rows follow the highest id, in the stated order."""
    kept = merged.filter("id IS NOT NULL")
    highest = kept.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    fresh = with_surrogate_id(merged.filter("id IS NULL").drop("id"), order)
    numbered = fresh.withColumn("id", F.col("id") + highest)
    return kept.unionByName(numbered.select(*merged.columns))


# --- games --------------------------------------------------------------------------------


def game_key(df: DataFrame) -> list[Column]:
    """The source's id of a game, else season, date, time, teams and raw names."""
    by_id = blank_to_null("source_game_id")
    rest = ("season_id", "game_date", "game_time", "home_team_id", "away_team_id",
            "home_team_name_raw", "away_team_name_raw")
    return [F.coalesce(F.concat(F.lit("id:"), by_id),
                       F.concat(F.lit("game:"), _key([F.col(c) for c in rest])))]


def incoming_games(parsed: DataFrame, teams: DataFrame, team_aliases: DataFrame) -> DataFrame:
    """Parsed games with resolved teams, ISO date and winner."""
    rows = parsed.withColumn("game_date", iso_date(F.col("game_date").cast("string")))
    for side in ("home", "away"):
        rows = resolve_team(rows, teams, team_aliases, f"{side}_team_name_raw", f"{side}_team_abbr_raw") \
            .withColumnRenamed("team_id", f"{side}_team_id")
    return rows.withColumn("winner_team_id", winner("home_team_id", "away_team_id", "home_score", "away_score"))


def merge_games(games: DataFrame, incoming: DataFrame, order: list) -> DataFrame:
    """``incoming`` as returned by ``incoming_games``; of a key the row read last wins.

    ``order`` names the columns that tell in which order the rows were read (such as run,
    page and position); a game's own date does not, as games are moved to earlier dates.
    """
    return upsert(games, incoming, game_key, order)


def unresolved_teams(incoming: DataFrame) -> DataFrame:
    """Team names of parsed games that no team matched."""
    side = lambda s: F.struct(
        F.lit(s).alias("side"), F.col(f"{s}_team_id").alias("team_id"),
        F.col(f"{s}_team_name_raw").alias("name"), F.col(f"{s}_team_abbr_raw").alias("abbr"))
    rows = incoming.select("season_id", F.inline(F.array(side("home"), side("away"))))
    return rows.filter("team_id IS NULL").select("season_id", "side", "name", "abbr").distinct()


def require_resolved_teams(incoming: DataFrame) -> DataFrame:
    """Strict mode: any unresolved team stops the merge."""
    if not unresolved_teams(incoming).isEmpty():
        raise RuntimeError("some teams could not be resolved")
    return incoming


# --- players and teams ------------------------------------------------------------------------


def link_observations(links: DataFrame) -> DataFrame:
    """Player links of all seasons reduced to one row per player slug.

    The single observations stay in the links table itself.
    """
    first = F.struct("season_id", "position")
    return links.groupBy("player_slug").agg(
        F.min_by("player_url", first).alias("player_url"),
        F.min_by("display_name", first).alias("display_name"),
        F.min("season_id").alias("first_seen_season_id"), F.max("season_id").alias("last_seen_season_id"),
        F.array_join(F.transform(F.array_sort(F.collect_set("season_id")), lambda s: s.cast("string")), ",").alias("season_ids"),
        F.count("*").alias("observations"),
    )


def incoming_players(observations: DataFrame, profiles: DataFrame, failed: DataFrame) -> DataFrame:
    """Player rows from profile pages; where there is none, from the links alone."""
    p = profiles.withColumn("__profile", F.lit(1))
    failures = failed.select("player_slug").distinct().withColumn("__failed", F.lit(1))
    rows = observations.withColumnRenamed("display_name", "link_name") \
        .join(p.drop("player_url"), "player_slug", "left").join(failures, "player_slug", "left")
    has = F.col("__profile").isNotNull()
    status = F.when(has, "success").when(F.col("__failed").isNotNull(), "failed").otherwise("stats_only")
    from_profile = ("photo_url", "birth_date", "position", "naturality", "height_cm", "weight_kg",
                    "profile_jersey_number")
    return rows.select(
        F.when(has, F.col("full_name")).otherwise(F.col("link_name")).alias("full_name"),
        F.coalesce(blank_to_null("display_name"), F.col("link_name")).alias("display_name"),
        F.col("player_slug").alias("slug"), F.col("player_url").alias("profile_url"),
        *[F.col(c) for c in from_profile if c in rows.columns],
        "first_seen_season_id", "last_seen_season_id", status.alias("scrape_status"),
        (status == "failed").cast("bigint").alias("needs_manual_review"), F.col("player_url").alias("source_url"),
    )


def merge_players(players: DataFrame, incoming: DataFrame) -> DataFrame:
    """By slug; only non-blank values overwrite."""
    return upsert(players, incoming, lambda df: [F.col("slug")], ["last_seen_season_id"], keep_old_if_blank=True)


def merge_teams(teams: DataFrame, seen: DataFrame, full_run: bool = True) -> DataFrame:
    """By slug; first and last season widen, other non-blank values overwrite.

    A full run also recomputes which teams were seen in the latest season.
    """
    rows = seen.select(
        F.coalesce(blank_to_null("season_display_name"), blank_to_null("logo_alt"), blank_to_null("link_text"),
                   F.col("abbreviation")).alias("canonical_name"),
        F.coalesce(blank_to_null("team_slug"), slugify(F.coalesce("season_display_name", "abbreviation"))).alias("slug"),
        "abbreviation", "logo_url", F.col("team_url").alias("profile_url"),
        F.col("season_id").alias("first_seen_season_id"), F.col("season_id").alias("last_seen_season_id"),
    )
    merged = upsert(
        teams.drop("is_active"), rows, lambda df: [F.col("slug")],
        ["last_seen_season_id", "canonical_name", "abbreviation"], keep_old_if_blank=True,
        combine={"first_seen_season_id": "least", "last_seen_season_id": "greatest"},
    )
    if not full_run:
        return merged.join(teams.select("slug", "is_active"), "slug", "left") \
            .withColumn("is_active", F.coalesce("is_active", F.lit(0)))
    return is_active(merged)


def is_active(teams: DataFrame) -> DataFrame:
    """1 for teams seen in the latest season of all."""
    latest = teams.select(F.max("last_seen_season_id")).scalar()
    return teams.withColumn("is_active", (F.col("last_seen_season_id") == latest).cast("bigint"))


# --- statistic lines --------------------------------------------------------------------------


def player_line_key(df: DataFrame) -> list[Column]:
    return [F.col("game_id"), F.col("team_id"), identity_key("player_name_raw"), blank_to_null("jersey_number")]


def team_line_key(df: DataFrame) -> list[Column]:
    return [F.col("game_id"), F.col("team_id")]


def lines_with_teams(lines: DataFrame, games: DataFrame) -> DataFrame:
    """Parsed lines (page side) with the ids of their game, team and opponent."""
    context = games.select(F.col("id").alias("game_id"), "season_id", "competition", "home_team_id", "away_team_id")
    ids = team_ids_for_side("side", "home_team_id", "away_team_id")
    return lines.join(context, "game_id").withColumn("__ids", ids).select(
        *[c for c in lines.columns], "season_id", "competition", "__ids.*"
    )


def merge_player_stats(stats: DataFrame, lines: DataFrame, records: DataFrame) -> DataFrame:
    """Resolve the players of new lines and upsert them by game, team, name, jersey."""
    resolved = resolve_players(lines, records)
    if "needs_manual_review" in stats.columns:
        resolved = resolved.withColumn("needs_manual_review", F.col("player_id").isNull().cast("bigint"))
    return upsert(stats, resolved, player_line_key, ["season_id", "game_id", "team_id", "player_name_raw"])


def unresolved_lines(lines: DataFrame, records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Lines whose player stays unknown, each once, and not if already queued."""
    resolved = resolve_players(lines, records).filter("player_id IS NULL")
    rows = resolved.withColumn("__key", _key(player_line_key(resolved)))
    rows = rows.groupBy("__key").agg(
        F.min(F.struct("game_id", "season_id", "team_id", "player_name_raw", "jersey_number", "candidates", "reason")).alias("r")
    ).select("__key", "r.*")
    if known is not None:
        rows = rows.join(known.select(_key(player_line_key(known)).alias("__key")), "__key", "left_anti")
    return rows.drop("__key")


def require_resolved_players(lines: DataFrame, records: DataFrame) -> DataFrame:
    """Strict mode: any unresolved player stops the merge."""
    if not unresolved_lines(lines, records).isEmpty():
        raise RuntimeError("some players could not be resolved")
    return lines


def merge_team_stats(stats: DataFrame, lines: DataFrame) -> DataFrame:
    return upsert(stats, lines, team_line_key, ["game_id", "team_id"])


# --- aliases ------------------------------------------------------------------------------------


def team_alias_key(df: DataFrame) -> list[Column]:
    return [F.col("team_id"), F.col("season_id"), F.lower(clean_text("alias")), F.col("alias_type")]


def player_alias_key(df: DataFrame) -> list[Column]:
    return [F.col("player_id"), F.col("season_id"), identity_key("alias"), F.col("alias_type"),
            blank_to_null("jersey_number"), identity_key("team_name_raw")]


def resolution_alias_key(df: DataFrame) -> list[Column]:
    return [F.col("player_id"), identity_key("alias"), F.col("season_id"), identity_key("team_name_raw"),
            blank_to_null("jersey_number")]


def new_aliases(existing: DataFrame, incoming: DataFrame, key, order: tuple[str, ...] = ()) -> DataFrame:
    """Incoming aliases whose key is not there yet, each key once.

    The first row by ``order`` counts, as the first writer would; without it, or where
    rows agree in it, the smallest row.
    """
    fields = [c for c in existing.columns if c != "id"]
    rows = incoming.select(*[F.col(c) if c in incoming.columns else F.lit(None).alias(c) for c in fields],
                           *[c for c in order if c not in fields])
    rows = computed(rows.withColumnRenamed("alias", "__alias"), alias=clean_text("__alias")).filter("alias IS NOT NULL")
    first = F.min(F.struct(*order, F.struct(*fields).alias("__row")))
    single = rows.groupBy(_key(key(rows)).alias("__key")).agg(first.alias("r")).select("__key", "r.__row.*")
    return single.join(existing.select(_key(key(existing)).alias("__key")), "__key", "left_anti").drop("__key")


def add_aliases(existing: DataFrame, incoming: DataFrame, key, order: tuple[str, ...] = ()) -> DataFrame:
    """Insert if absent; new rows carry no id until ``assign_ids``."""
    fresh = new_aliases(existing, incoming, key, order)
    return existing.withColumn("change", F.lit("unchanged")).unionByName(
        fresh.withColumn("change", F.lit("inserted")), allowMissingColumns=True
    )


def profile_aliases(profiles: DataFrame) -> DataFrame:
    """Names on profile pages by ``player_slug``, valid in any season: the full name is the primary one."""
    none = lambda kind: F.lit(None).cast(kind)
    names = [F.struct(F.col(c).alias("alias"), F.lit(c).alias("alias_type"), F.lit(int(c == "full_name")).cast("bigint").alias("is_primary"))
             for c in ("full_name", "display_name") if c in profiles.columns]
    return profiles.select("player_slug", F.inline(F.array(*names))).select(
        "player_slug", none("bigint").alias("season_id"), "alias", "alias_type", none("string").alias("jersey_number"),
        none("string").alias("team_name_raw"), F.lit("player_profile").alias("source"), "is_primary", none("bigint").alias("position"))


def observation_aliases(links: DataFrame) -> DataFrame:
    """Names under which statistics pages list a player, each with its season, jersey and raw team."""
    return links.select(
        "player_slug", F.col("season_id").cast("bigint").alias("season_id"), F.col("display_name").alias("alias"),
        F.lit("stats_display_name").alias("alias_type"), "jersey_number", "team_name_raw", F.lit("season_stats_efficiency").alias("source"),
        F.lit(0).cast("bigint").alias("is_primary"), F.col("position").cast("bigint").alias("position"))


def add_player_names(existing: DataFrame, players: DataFrame, profiles: DataFrame, links: DataFrame) -> DataFrame:
    """Aliases of stored players (``id``, ``slug``) from profiles and link observations, inserted if absent.

    Of the names with one key (player, season, name, type, jersey, team) the one read first stays,
    by ``position``.  Blank names, and slugs that no stored player has, give no row.
    """
    names = profile_aliases(profiles).unionByName(observation_aliases(links))
    owners = players.select(F.col("id").alias("player_id"), F.col("slug").alias("player_slug")).dropna()
    return add_aliases(existing, names.join(owners, "player_slug").drop("player_slug"), player_alias_key, ("position",))


#: Order in which new player aliases get their ids.
PLAYER_ALIAS_ORDER = ["player_id", "season_id", "alias_type", "alias", "jersey_number", "team_name_raw"]


# --- queues ---------------------------------------------------------------------------------------


def failed_queue(queue: DataFrame, failures: DataFrame, succeeded: DataFrame | None = None,
                 key: str = "game_id") -> DataFrame:
    """Drop what succeeded meanwhile, then upsert the new failures."""
    open_ = queue if succeeded is None else queue.join(succeeded.select(key).distinct(), key, "left_anti")
    return upsert(open_.select(*queue.columns), failures, lambda df: [F.col(key)], ["error_type", "error_message"])


def select_suggestions(suggestions: DataFrame, auto: bool = True, reviewed: bool = True) -> DataFrame:
    """Suggestions to apply: decided automatically, or approved by a reviewer.

    Two approvals for one group are an error.
    """
    approved = F.coalesce(blank_to_null("approved") == "1", F.lit(False))
    if reviewed:
        group = ["season_id", "team_id", "player_name_raw", "jersey_number"]
        twice = suggestions.filter(approved).groupBy(*group).count().filter("count > 1")
        if not twice.isEmpty():
            raise ValueError("a group has more than one approved candidate")
    wanted = F.lit(False)
    if auto:
        wanted = wanted | (F.col("decision") == "auto")
    if reviewed:
        wanted = wanted | approved
    return suggestions.filter(wanted & F.col("suggested_player_id").isNotNull())


#: Type and source of aliases that come from decided suggestions.
AUTOMATIC = ("boxscore_manual_auto", "player_resolution_suggestions")
REVIEWED = ("boxscore_manual_review", "player_manual_review_candidates")


def resolution_aliases(selected: DataFrame, alias_type: str, source: str) -> DataFrame:
    return selected.select(
        F.col("suggested_player_id").alias("player_id"), clean_text("player_name_raw").alias("alias"),
        F.lit(alias_type).alias("alias_type"), "season_id", "team_id",
        (F.col("team_name_raw") if "team_name_raw" in selected.columns else F.lit(None).cast("string")).alias("team_name_raw"),
        "jersey_number", F.lit(source).alias("source"),
    )


def apply_resolutions(stats: DataFrame, selected: DataFrame, players: DataFrame, aliases: DataFrame,
                      team_aliases: DataFrame | None = None, decided_by: tuple[str, str] = AUTOMATIC) -> DataFrame:
    """Turn decided suggestions into aliases and resolve the open lines again.

    Lines that have a player are not touched; the rest stay open with the reason.
    ``decided_by`` is the type and source of the new aliases.
    """
    extended = add_aliases(aliases, resolution_aliases(selected, *decided_by), resolution_alias_key).drop("change")
    records = name_records(players, extended, team_aliases)
    done = stats.filter("player_id IS NOT NULL").withColumn("reason", F.lit(None).cast("string"))
    open_ = resolve_players(stats.filter("player_id IS NULL"), records)
    return done.unionByName(open_.select(*stats.columns, "reason"))


def remove_dnp(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of players who played, removed lines)."""
    return stats.filter(~is_dnp(stats)), stats.filter(is_dnp(stats))


def remove_dnp_and_resolve(stats: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept lines, removed lines, queue): players who did not play go, and what stays open is resolved again.

    Only kept lines without a player are resolved, so lines with one are passed on as they
    are; the queue is rebuilt from what is still open, a row per line, with reason and number of candidates.
    """
    kept, removed = remove_dnp(stats)
    decided = resolve_players(kept.filter("player_id IS NULL"), records)
    found = kept.filter("player_id IS NOT NULL").unionByName(decided.select(*stats.columns))
    queue = decided.filter("player_id IS NULL").select(
        *[c for c in ("game_id", "season_id", "team_id", "player_name_raw", "jersey_number", "source_url") if c in stats.columns], "reason", "candidates")
    return found, removed, queue


TEAM_ONLY_ERROR = "empty_boxscore_template"


def remove_team_only(player_stats: DataFrame, team_stats: DataFrame, games: DataFrame,
                     queue: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept team lines, report of removed games, failed queue with those games)."""
    bad = team_only_games(player_stats, team_stats)
    kept = team_stats.join(bad.select("game_id"), "game_id", "left_anti").select(*team_stats.columns)
    report = bad.join(
        games.select(F.col("id").alias("game_id"), "season_id", "boxscore_url"), "game_id", "left"
    )
    failures = report.select(
        "game_id", "season_id", "boxscore_url", F.lit(TEAM_ONLY_ERROR).alias("error_type"),
        F.lit("team lines without any player line").alias("error_message"),
    )
    return kept, report, failed_queue(queue, failures)


def run_log(job: str, target: str, merged: DataFrame, failed: DataFrame) -> DataFrame:
    """One log row for a run: counters of the merge, partial when something failed."""
    count = lambda kind: F.count_if(F.col("change") == kind)
    counters = merged.agg(
        F.count("*").alias("items_found"), count("inserted").alias("items_inserted"), count("updated").alias("items_updated")
    )
    failures = failed.select(F.count("*")).scalar()
    status = F.when(F.col("items_failed") > 0, "partial").otherwise("success")
    return counters.withColumn("items_failed", failures).select(
        F.lit(job).alias("job"), F.lit(target).alias("target"), status.alias("status"),
        "items_found", "items_inserted", "items_updated", "items_failed",
    )


# --- history of runs ------------------------------------------------------------------------------

RUN = ("run_id bigint, job string, target string, started_at timestamp, finished_at timestamp, status string,"
       " items_found bigint, items_inserted bigint, items_updated bigint, items_failed bigint")


def _write_run(run: DataFrame, folder: str) -> None:
    """The row of one run in a folder of its own: written again, it replaces itself and no other run."""
    run.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(folder)


def start_run(spark: SparkSession, folder: str, run_id: int, job: str, target: str, started_at: datetime) -> None:
    """Note that a run began: status ``running``, no counters."""
    _write_run(spark.createDataFrame([(run_id, job, target, started_at, None, "running", None, None, None, None)], RUN), folder)


def finish_run(spark: SparkSession, folder: str, run_id: int, merged: DataFrame, failed: DataFrame, finished_at: datetime) -> None:
    """Replace the row of a started run by its counters and status; a repeated call changes nothing else."""
    begun = read_runs(spark, folder).filter(F.col("run_id") == run_id).first()
    if begun is None:
        raise ValueError(f"run {run_id} was not started")
    counted = run_log(begun["job"], begun["target"], merged, failed).withColumns({
        "run_id": F.lit(run_id).cast("bigint"), "started_at": F.lit(begun["started_at"]).cast("timestamp"), "finished_at": F.lit(finished_at).cast("timestamp")})
    _write_run(counted.select(*[c.split()[0] for c in RUN.split(", ")]), folder)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RUN.replace(", ", ",")).parquet(folder)
