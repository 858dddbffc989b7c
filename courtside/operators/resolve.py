"""Raw names to entity ids: teams and players.

All strategies of a resolver are tried with one equi-join: records are turned into
one lookup row per strategy key, requests into one row per strategy, and the best
strategy that found something decides.  A lookup key occurs once, so a name shared
by very many records never multiplies the requests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, clean_text, identity_key, slugify
from ..session import computed, expanded
from .positions import top_per_group

CONTEXT = ["season_id", "team_id", "jersey_number"]
REQUEST = ["season_id", "team_id", "player_name_raw", "jersey_number"]


# --- teams --------------------------------------------------------------------------


def season_aliases(aliases: DataFrame) -> DataFrame:
    """(season_id, key) -> team; the alias with the highest id wins."""
    rows = computed(aliases.select(F.col("season_id").cast("string").alias("season_id"), "alias", "team_id", "id"), key=identity_key("alias")) \
        .dropna(subset=["season_id", "key", "team_id"])
    return rows.groupBy("season_id", "key").agg(F.max_by("team_id", F.struct("id", "team_id")).alias("team_id"))


def global_team_keys(teams: DataFrame) -> DataFrame:
    """key -> team over canonical name, abbreviation and slug."""
    values = [clean_text(c) for c in ("canonical_name", "abbreviation", "slug") if c in teams.columns]
    rows = teams.select(F.col("id").alias("team_id"), F.explode(F.array(*values)).alias("value"))
    keys = F.array(identity_key("value"), identity_key(slugify("value")))
    return rows.select("team_id", F.explode(keys).alias("key")).dropna() \
        .groupBy("key").agg(F.max("team_id").alias("team_id"))


def resolve_team(requests: DataFrame, teams: DataFrame, aliases: DataFrame, name: str = "team_name_raw",
                 abbreviation: str | None = "team_abbr_raw") -> DataFrame:
    """Adds ``team_id``: the season's aliases first, then names valid in any season;
    within each the name, the abbreviation and the slug are tried in that order."""
    tried = [F.col(name)]
    if abbreviation:
        tried.append(F.col(abbreviation))
    tried.append(slugify(name))
    n = len(tried)
    season = season_aliases(aliases).withColumn("scope", F.lit("season"))
    anywhere = global_team_keys(teams).select(
        F.lit("").alias("season_id"), "key", "team_id", F.lit("global").alias("scope")
    )
    lookup = season.unionByName(anywhere)

    distinct = requests.select("season_id", name, *([abbreviation] if abbreviation else [])).distinct()
    attempts = [
        F.struct(
            F.lit(i + (n if scope == "global" else 0)).alias("priority"), F.lit(scope).alias("scope"),
            (F.col("season_id").cast("string") if scope == "season" else F.lit("")).alias("attempt_season"),
            identity_key(c).alias("key"),
        )
        for scope in ("season", "global") for i, c in enumerate(tried)
    ]
    keyed = distinct.select("*", F.inline(F.array(*attempts))).filter("key IS NOT NULL")
    found = keyed.join(
        lookup.withColumnRenamed("season_id", "attempt_season"), ["scope", "attempt_season", "key"]
    )
    by = distinct.columns
    best = found.groupBy(*by).agg(F.min_by("team_id", "priority").alias("team_id"))
    return _join_null_safe(requests.drop("team_id"), best, by)


def _join_null_safe(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in by else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in by])
    return left.join(renamed, condition, how).drop(*[f"__r_{c}" for c in by])


# --- players ------------------------------------------------------------------------


def name_records(players: DataFrame, aliases: DataFrame, team_aliases: DataFrame | None = None) -> DataFrame:
    """All known names of players with the context in which each is known.

    Aliases carry season, team and jersey; full and display names none.  An alias's
    team name is resolved when ``team_aliases`` is given, else its ``team_id`` is used.
    """
    rows = computed(aliases.filter("player_id IS NOT NULL"), __name=clean_text("alias")).filter("__name IS NOT NULL")
    if team_aliases is not None:
        rows = _alias_teams(rows, team_aliases)
    from_aliases = rows.select(
        "player_id", F.col("__name").alias("name"), F.col("season_id").cast("bigint").alias("season_id"),
        F.col("team_id").cast("bigint").alias("team_id"), blank_to_null("jersey_number").alias("jersey_number"),
        (F.coalesce(blank_to_null("source"), F.lit("player_aliases")) if "source" in aliases.columns
         else F.lit("player_aliases")).alias("source"),
    )
    own = [
        F.struct(clean_text(c).alias("name"), F.lit(f"players.{c}").alias("source"))
        for c in ("full_name", "display_name") if c in players.columns
    ]
    none = lambda kind: F.lit(None).cast(kind)
    from_players = players.select(F.col("id").alias("player_id"), F.inline(F.array(*own))).select(
        "player_id", "name", none("bigint").alias("season_id"), none("bigint").alias("team_id"),
        none("string").alias("jersey_number"), "source",
    ).filter("name IS NOT NULL AND player_id IS NOT NULL")
    return from_aliases.unionByName(from_players)


def _alias_teams(aliases: DataFrame, team_aliases: DataFrame) -> DataFrame:
    """Team of an alias by its raw team name: in its season, else in any."""
    in_season = season_aliases(team_aliases).withColumnRenamed("team_id", "__season_team")
    anywhere = computed(team_aliases.select("alias", "team_id", "id"), key=identity_key("alias")).dropna() \
        .groupBy("key").agg(F.max_by("team_id", F.struct("id", "team_id")).alias("__any_team"))
    keyed = aliases.drop("team_id").withColumn("key", identity_key("team_name_raw")) \
        .withColumn("__season", F.col("season_id").cast("string"))
    return (
        keyed.join(in_season.withColumnRenamed("season_id", "__season"), ["__season", "key"], "left")
        .join(anywhere, "key", "left")
        .withColumn("team_id", F.coalesce("__season_team", "__any_team"))
        .drop("key", "__season", "__season_team", "__any_team")
    )


# strategies in order; each lists the context fields that must be equal, and whether
# a record must have no jersey / no context at all
_STRATEGIES: list[tuple[tuple[str, ...], str | None]] = [
    (("season_id", "team_id", "jersey_number"), None),
    (("season_id", "team_id"), "no_jersey"),
    (("season_id", "team_id"), None),
    (("season_id", "jersey_number"), None),
    (("season_id",), None),
    ((), "no_context"),
]
_ANY = len(_STRATEGIES)          # any record of that name: only tells that the name is known


def _context_text(field: str) -> Column:
    return F.coalesce(F.col(field).cast("string"), F.lit(""))


def _strategy_keys(with_conditions: bool) -> Column:
    """One struct per strategy; as an array, with fields outside the key blanked."""
    out = []
    for i, (fields, condition) in enumerate([*_STRATEGIES, ((), None)]):
        applies = F.lit(True)
        if with_conditions and condition == "no_jersey":
            applies = F.col("jersey_number").isNull()
        elif with_conditions and condition == "no_context":
            applies = F.col("season_id").isNull() & F.col("team_id").isNull() & F.col("jersey_number").isNull()
        out.append(F.struct(
            F.lit(i).alias("strategy"), applies.alias("applies"),
            *[(_context_text(f) if f in fields else F.lit("")).alias(f"k_{f}") for f in CONTEXT],
        ))
    return F.array(*out)


_LOOKUP_KEY = ["name_key", "strategy", *[f"k_{f}" for f in CONTEXT]]


def _keyed_records(records: DataFrame) -> DataFrame:
    return computed(records.select("name", "player_id", *CONTEXT), name_key=identity_key("name")).filter("name_key IS NOT NULL")


def _records_by_strategy(keyed: DataFrame) -> DataFrame:
    return keyed.select("name_key", "player_id", F.inline(_strategy_keys(True))).filter("applies").select(*_LOOKUP_KEY, "player_id")


def player_lookup(records: DataFrame, tasks: int | None = None) -> DataFrame:
    """Strategy key -> number of players and the smallest id.

    Reduced to distinct players first; the count then works on one row per player.  With ``tasks``
    records move by name and player, over so many tasks, before each becomes a row per strategy;
    else these rows move, and the planner sizes their partitions.
    """
    keyed = _keyed_records(records)
    if tasks:
        keyed = keyed.repartition(tasks, "name_key", "player_id")
    return _records_by_strategy(keyed).distinct().groupBy(*_LOOKUP_KEY).agg(
        F.count("*").alias("candidates"), F.min("player_id").alias("player_id")
    )


# names with at most so many lookup rows decide a request beside the name, the others by a join per strategy
MAX_BESIDE = 64


def _beside_names(lookup: DataFrame) -> DataFrame:
    """name_key -> its lookup rows as a list, or one that is too long and cut one past the limit."""
    entry = F.struct(*[c for c in lookup.columns if c != "name_key"])
    return top_per_group(lookup, ["name_key"], _LOOKUP_KEY[1:], MAX_BESIDE + 1, "__pos").groupBy("name_key").agg(
        F.collect_list(entry).alias("entries"))


def _best_beside(entries: Column) -> Column:
    """The best strategy's row among a name's lookup rows."""

    def fits(e: Column) -> Column:
        return reduce(lambda a, b: a & b, [
            ~e["strategy"].isin(*[i for i, (fields, _) in enumerate(_STRATEGIES) if f in fields]) | (e[f"k_{f}"] == F.col(f"t_{f}"))
            for f in CONTEXT])

    hits = F.transform(F.filter(entries, fits), lambda e: F.struct(e["strategy"].alias("strategy"), e["candidates"].alias("candidates"), e["player_id"].alias("player_id")))
    return F.array_min(hits)


def resolve_requests(requests: DataFrame, records: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per distinct (season, team, name, jersey): player_id, reason, strategy,
    number of candidates.

    Requests move once to the lookup rows of their name.  Only requests whose name has more
    than ``MAX_BESIDE`` of these become one row per strategy.  ``tasks`` is the number over
    which the records are dealt.
    """
    distinct = computed(requests.select(
        F.col("season_id").cast("bigint").alias("season_id"), F.col("team_id").cast("bigint").alias("team_id"),
        "player_name_raw", blank_to_null("jersey_number").alias("jersey_number"),
    ).distinct(), name_key=identity_key("player_name_raw"))
    lookup = player_lookup(records, tasks)
    names = _beside_names(lookup)
    long = F.size("entries") > MAX_BESIDE
    texts = {f"t_{f}": _context_text(f) for f in CONTEXT}
    few = distinct.join(expanded(names), "name_key", "left").filter(F.col("entries").isNull() | ~long) \
        .withColumns(texts).select(*REQUEST, _best_beside(F.col("entries")).alias("best"), "name_key")
    attempts = distinct.join(names.filter(long).select("name_key"), "name_key").select("*", F.inline(_strategy_keys(False)))
    many = attempts.join(expanded(lookup), _LOOKUP_KEY).groupBy(*REQUEST).agg(
        F.min(F.struct("strategy", "candidates", "player_id")).alias("best"),
        F.max("name_key").alias("name_key"),
    )
    best = few.unionByName(many)
    safe = F.col("best.strategy") < _ANY
    reason = (
        F.when(F.col("name_key").isNull(), "empty_player_name")
        .when(F.col("best").isNull(), "no_alias_match")
        .when(~safe, "no_safe_match")
        .when(F.col("best.candidates") == 1, "resolved")
        .otherwise("ambiguous_match")
    )
    return best.select(
        *REQUEST, reason.alias("reason"),
        F.when(safe & (F.col("best.candidates") == 1), F.col("best.player_id")).alias("player_id"),
        F.when(safe, F.col("best.strategy") + 1).cast("bigint").alias("strategy"),
        F.coalesce("best.candidates", F.lit(0)).cast("bigint").alias("candidates"),
    )


def resolve_players(lines: DataFrame, records: DataFrame) -> DataFrame:
    """Statistic lines with ``player_id``, ``reason`` and number of ``candidates``."""
    typed = lines.drop("player_id", "reason").withColumns({
        "season_id": F.col("season_id").cast("bigint"), "team_id": F.col("team_id").cast("bigint"),
        "jersey_number": blank_to_null("jersey_number"),
    })
    decided = resolve_requests(lines, records).drop("strategy")
    return _join_null_safe(typed, decided, REQUEST)


def resolution_candidates(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """The players between which an unresolved request could not decide, one per row.

    ``resolved`` is the output of ``resolve_requests``.  Kept as rows: a common name
    may have more candidates than belong into one cell.
    """
    open_ = resolved.filter(F.col("reason").isin("ambiguous_match", "no_safe_match")).withColumn(
        "strategy", F.coalesce(F.col("strategy") - 1, F.lit(_ANY))
    ).withColumn("name_key", identity_key("player_name_raw"))
    attempts = open_.withColumnRenamed("strategy", "wanted").select(
        "name_key", *REQUEST, "wanted", F.inline(_strategy_keys(False))
    ).filter("strategy = wanted")
    members = _records_by_strategy(_keyed_records(records)).distinct()
    return attempts.join(members, _LOOKUP_KEY).select(*REQUEST, "player_id")


def unresolved_groups(lines: DataFrame, sample: list[str]) -> DataFrame:
    """Lines without a player by (season, team, name, jersey), counted, with one
    sample line (the smallest by the ``sample`` columns)."""
    rows = lines.filter(F.col("player_id").isNull())
    return rows.groupBy(*REQUEST).agg(
        F.count("*").alias("unresolved_rows"),
        F.min(F.struct(*sample)).alias("__sample"),
    ).select(*REQUEST, "unresolved_rows", *[F.col(f"__sample.{c}").alias(f"sample_{c}") for c in sample])
