"""Upserts and queues: stored tables hold the earlier seasons, runs bring the later
ones; one season is in both, with changed values."""

from pyspark.sql import functions as F

from ..operators import merge, resolve, similar
from ..session import cut_lineage, scratch_path, tasks_for
from ..sources.tables import write_table
from .bindings import VIEWS, add_view, sql
from .on_quality import _failed, _player_lines, _team_lines
from .on_resolution import REQUEST, SAME, _groups, _team_aliases
from .on_functions import s_key
from .registry import query

STORED, BOTH = 1998, 1997         # stored: before 1998; run: from 1997 on


# --- games ---------------------------------------------------------------------------------------

NAME_OF = "case when {t} < 25 then 'NATION_' || cast({t} as string) else 'T' || cast({t} as string) end"
GAME = {
    "id": "id", "season_id": "season_id", "competition": "competition", "game_number": "cast(id as string)",
    "source_game_id": "case when id % 50 = 1 then null else cast(id as string) end",
    "game_date": "cast(game_date as string)", "game_time": "game_time", "round": "round", "phase": "phase",
    "home_team_id": "home_team_id", "away_team_id": "away_team_id",
    "home_team_name_raw": NAME_OF.format(t="home_team_id"), "away_team_name_raw": NAME_OF.format(t="away_team_id"),
    "home_team_abbr_raw": "home_team_abbr_raw", "away_team_abbr_raw": "away_team_abbr_raw",
    "home_score": "home_score", "away_score": "away_score",
    "winner_team_id": "case when home_score > away_score then home_team_id when away_score > home_score then away_team_id end",
    "boxscore_url": "boxscore_url",
}
_NEW_SCORE = f"home_score + case when season_id = {BOTH} then 1 else 0 end"


def _stored_games(t):
    return t.games.filter(F.col("season_id") < STORED).selectExpr(*[f"{e} AS {n}" for n, e in GAME.items()])


def _run_games(t):
    parsed = {**GAME, "home_score": _NEW_SCORE,
              "game_date": "cast(day(game_date) as string) || '/' || cast(month(game_date) as string) || '/' || cast(year(game_date) as string)"}
    for name in ("id", "home_team_id", "away_team_id", "winner_team_id"):
        parsed.pop(name)
    rows = t.games.filter(F.col("season_id") >= BOTH).selectExpr(*[f"{e} AS {n}" for n, e in parsed.items()])
    return merge.incoming_games(rows, t.teams, _team_aliases(t))


def _game_columns(score):
    own = {**GAME, "home_score": score,
           "winner_team_id": f"case when {score} > away_score then home_team_id when away_score > {score} then away_team_id end"}
    return ", ".join(f"{e} AS {n}" for n, e in own.items() if n != "id")


add_view("b_merged_games", ("b_games",),
         f"SELECT CASE WHEN season_id < {STORED} THEN id END AS id, {_game_columns('new_score')}, CASE WHEN season_id >= {STORED} THEN 'inserted' WHEN season_id = {BOTH} THEN 'updated' ELSE 'unchanged' END AS change"
         f" FROM (SELECT *, {_NEW_SCORE} AS new_score FROM b_games)")


#: The run's games come from one list, read in this order.
READ_ORDER = ["season_id", "game_date", "game_time", "game_number"]


@query("merge_games", sql("b_merged_games", "SELECT * FROM b_merged_games"))
def _(t):
    return merge.merge_games(_stored_games(t), _run_games(t), READ_ORDER)


@query("merge_games_with_ids", sql("b_merged_games", "SELECT coalesce(id, (SELECT max(id) FROM b_merged_games) + row_number() OVER (PARTITION BY id IS NULL ORDER BY season_id, game_date, game_time, game_number)) AS id,"
       " season_id, game_number, change FROM b_merged_games"))
def _(t):
    merged = merge.merge_games(_stored_games(t), _run_games(t), READ_ORDER)
    return merge.assign_ids(merged, READ_ORDER).select("id", "season_id", "game_number", "change")


@query("merge_games_counts", sql("b_merged_games", "SELECT change, count(*) AS rows FROM b_merged_games GROUP BY change"))
def _(t):
    return merge.change_counts(merge.merge_games(_stored_games(t), _run_games(t), READ_ORDER))


@query("upsert_partitions", sql("b_merged_games", f"SELECT id, {', '.join(c for c in GAME if c != 'id')} FROM b_merged_games"))
def _(t):
    """The table as it stands after a run that rewrites the seasons from the shared one on."""
    path = scratch_path(t.spark, "games")
    write_table(_stored_games(t), path, partition_by=("season_id",))
    merge.upsert_partitions(t.spark, path, _run_games(t), merge.game_key, READ_ORDER)
    return t.spark.read.parquet(path).withColumn("season_id", F.col("season_id").cast("bigint")).select(*GAME)


@query("unresolved_teams", sql("b_games", "SELECT DISTINCT season_id, 'home' AS side, 'Clube ' || cast(home_team_id as string) AS name, 'C' || cast(home_team_id as string) AS abbr FROM b_games WHERE home_team_id >= 20"))
def _(t):
    rows = t.games.selectExpr(
        "season_id", "id", "cast(game_date as string) AS game_date", "game_time", "home_score", "away_score",
        "case when home_team_id >= 20 then 'Clube ' || home_team_id else 'Nation ' || home_team_id end AS home_team_name_raw",
        "case when home_team_id >= 20 then 'C' || home_team_id end AS home_team_abbr_raw", "'x' AS away_team_name_raw",
        "'T' || away_team_id AS away_team_abbr_raw")
    return merge.unresolved_teams(merge.incoming_games(rows, t.teams, _team_aliases(t)))


# --- players and teams ---------------------------------------------------------------------------------

add_view("b_stored_players", (), "SELECT s_suppkey AS id, s_name AS full_name, lower(replace(s_name, '#', '-')) AS slug, 'Ala' AS position, 1995 AS last_seen_season_id FROM supplier WHERE s_nationkey < 20")
add_view("b_run_players", (), "SELECT 'N ' || s_name AS full_name, lower(replace(s_name, '#', '-')) AS slug, CASE WHEN s_nationkey % 2 = 0 THEN ' ' ELSE 'Pivô' END AS position, 1998 AS last_seen_season_id FROM supplier WHERE s_nationkey >= 10")


def _supplier(t, text):
    return t.spark.sql(text.replace("FROM supplier", "FROM {supplier}"), supplier=t.raw("supplier"))


@query("merge_players", sql(("b_stored_players", "b_run_players"),
       "SELECT o.id, coalesce(n.full_name, o.full_name) AS full_name, slug, CASE WHEN trim(n.position) <> '' THEN n.position ELSE coalesce(o.position, NULL) END AS position,"
       " coalesce(n.last_seen_season_id, o.last_seen_season_id) AS last_seen_season_id, CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.slug IS NULL THEN 'unchanged' ELSE 'updated' END AS change"
       " FROM b_stored_players o FULL JOIN b_run_players n USING (slug)"))
def _(t):
    return merge.merge_players(_supplier(t, VIEWS["b_stored_players"][1]), _supplier(t, VIEWS["b_run_players"][1]))


# the stored table knows some teams under another slug, and its seasons end where the run's begin
_SLUG = "case when home_team_id < 20 then 'time-' || cast(home_team_id as string) else 'equipe-' || cast(home_team_id as string) end"


@query("merge_teams", sql("b_games",
       "SELECT h.id, coalesce(a.name, h.name) AS canonical_name, slug, coalesce(a.abbreviation, h.abbreviation) AS abbreviation, least(h.lo, a.lo) AS first_seen_season_id, greatest(h.hi, a.hi) AS last_seen_season_id,"
       " CASE WHEN h.id IS NULL THEN 'inserted' WHEN a.slug IS NULL THEN 'unchanged' ELSE 'updated' END AS change, cast(greatest(h.hi, a.hi) = (SELECT max(season_id) FROM b_games) AS bigint) AS is_active FROM"
       f" (SELECT home_team_id AS id, 'H' || cast(home_team_id as string) AS name, {_SLUG} AS slug, 'H' AS abbreviation, min(least(season_id, 1997)) AS lo, max(least(season_id, 1997)) AS hi FROM b_games GROUP BY home_team_id) h"
       f" FULL JOIN (SELECT 'A' || cast(away_team_id as string) AS name, 'time-' || cast(away_team_id as string) AS slug, 'A' AS abbreviation, min(greatest(season_id, 1997)) AS lo, max(greatest(season_id, 1997)) AS hi FROM b_games GROUP BY away_team_id) a USING (slug)"))
def _(t):
    stored = t.games.withColumn("season", F.least("season_id", F.lit(1997))).groupBy("home_team_id").agg(
        F.min("season").alias("first_seen_season_id"), F.max("season").alias("last_seen_season_id")
    ).selectExpr("home_team_id AS id", "'H' || home_team_id AS canonical_name", f"{_SLUG} AS slug", "'H' AS abbreviation", "first_seen_season_id", "last_seen_season_id", "0L AS is_active")
    seen = t.games.selectExpr(
        "greatest(season_id, 1997) AS season_id", "'time-' || away_team_id AS team_slug", "'A' || away_team_id AS season_display_name", "'A' AS abbreviation",
        "cast(null AS string) AS logo_alt", "cast(null AS string) AS link_text", "cast(null AS string) AS logo_url", "cast(null AS string) AS team_url")
    return merge.merge_teams(stored, seen)


@query("is_active", sql("b_teams", "SELECT id, last_seen_season_id, cast(last_seen_season_id = (SELECT max(last_seen_season_id) FROM b_teams) AS bigint) AS is_active FROM b_teams"))
def _(t):
    return merge.is_active(t.teams.select("id", "last_seen_season_id"))


@query("link_observations", sql("b_stats",
       "SELECT player_slug, '/atletas/' || player_slug AS player_url, arg_min(display_name, (season_id, position)) AS display_name, min(season_id) AS first_seen_season_id, max(season_id) AS last_seen_season_id,"
       " string_agg(DISTINCT cast(season_id as string), ',' ORDER BY cast(season_id as string)) AS season_ids, count(*) AS observations FROM"
       " (SELECT 'atleta-' || cast(player_id as string) AS player_slug, 'J ' || cast(line_no as string) AS display_name, season_id, game_id * 10 + line_no AS position FROM b_stats) GROUP BY player_slug"))
def _(t):
    return merge.link_observations(_links(t))


def _links(t):
    return t.stats.selectExpr(
        "'atleta-' || player_id AS player_slug", "'/atletas/atleta-' || player_id AS player_url", "'J ' || line_no AS display_name",
        "season_id", "game_id * 10 + line_no AS position")


# --- statistic lines ---------------------------------------------------------------------------------------

LINE = "game_id, season_id, team_id, player_name_raw, jersey_number"
add_view("b_stored_lines", ("b_stats",), f"SELECT {LINE}, max(points) AS points FROM b_stats WHERE season_id < {STORED} GROUP BY {LINE}")
add_view("b_run_lines", ("b_stats",), f"SELECT {LINE}, max(points) + 1 AS points FROM b_stats WHERE season_id >= {BOTH} GROUP BY {LINE}")
add_view("b_known", ("b_players",), "SELECT id AS player_id, 'JOGADOR-' || cast(id as string) AS alias FROM b_players WHERE full_name IS NOT NULL")


def _stored_lines(t):
    return t.stats.filter(F.col("season_id") < STORED).groupBy(*LINE.split(", ")).agg(F.max("points").alias("points")).select(
        *LINE.split(", "), F.lit(None).cast("bigint").alias("player_id"), "points", F.lit(1).cast("bigint").alias("needs_manual_review"))


def _run_lines(t):
    return t.stats.filter(F.col("season_id") >= BOTH).select(*LINE.split(", "), (F.col("points") + 1).alias("points"))


def _known(t):
    aliases = t.players.filter("full_name IS NOT NULL").selectExpr(
        "id AS player_id", "'JOGADOR-' || id AS alias", "cast(null AS bigint) AS season_id", "cast(null AS bigint) AS team_id", "cast(null AS string) AS jersey_number")
    return resolve.name_records(t.players.select("id", "full_name"), aliases)


@query("merge_player_stats", sql(("b_stored_lines", "b_run_lines", "b_known"),
       "SELECT game_id, season_id, team_id, player_name_raw, jersey_number, k.player_id, coalesce(n.points, o.points) AS points,"
       " cast(CASE WHEN n.points IS NULL THEN 1 WHEN k.player_id IS NULL THEN 1 ELSE 0 END AS bigint) AS needs_manual_review,"
       " CASE WHEN o.points IS NULL THEN 'inserted' WHEN n.points IS NULL THEN 'unchanged' ELSE 'updated' END AS change"
       " FROM b_stored_lines o FULL JOIN b_run_lines n USING (game_id, season_id, team_id, player_name_raw, jersey_number)"
       " LEFT JOIN b_known k ON n.points IS NOT NULL AND replace(k.alias, 'JOGADOR-', 'Jogador ') = player_name_raw"))
def _(t):
    return merge.merge_player_stats(_stored_lines(t), _run_lines(t), _known(t))


@query("unresolved_lines", sql(("b_run_lines", "b_known"), "SELECT game_id, season_id, team_id, player_name_raw, jersey_number, 0::bigint AS candidates, 'no_alias_match' AS reason FROM b_run_lines"
       " WHERE replace(player_name_raw, 'Jogador ', 'JOGADOR-') NOT IN (SELECT alias FROM b_known)"))
def _(t):
    return merge.unresolved_lines(_run_lines(t), _known(t))


@query("merge_team_stats", sql("b_team_stats",
       f"SELECT game_id, season_id, competition, team_id, points + CASE WHEN season_id >= {BOTH} THEN 1 ELSE 0 END AS points, assists,"
       f" CASE WHEN season_id >= {STORED} THEN 'inserted' WHEN season_id = {BOTH} THEN 'updated' ELSE 'unchanged' END AS change FROM b_team_stats"))
def _(t):
    lines = t.team_stats.select("game_id", "season_id", "competition", "team_id", "points", "assists")
    run = lines.filter(F.col("season_id") >= BOTH).withColumn("points", F.col("points") + 1)
    return merge.merge_team_stats(lines.filter(F.col("season_id") < STORED), run)


@query("remove_dnp", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag <> 'R' AS kept FROM lineitem")
def _(t):
    zero = ", ".join(f"case when l_returnflag = 'R' then 0 else l_linenumber end AS {s}" for s in merge_stats())
    lines = t.raw("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity", "case when l_returnflag = 'R' then 0.0D else l_quantity end AS minutes_decimal", *zero.split(", "))
    kept, removed = merge.remove_dnp(lines)
    keep = ["l_orderkey", "l_linenumber", "l_quantity"]
    return kept.select(*keep, F.lit(True).alias("kept")).unionByName(removed.select(*keep, F.lit(False).alias("kept")))


def merge_stats():
    from ..constants import STAT_INPUTS

    return STAT_INPUTS


@query("drop_dnp", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag <> 'R' OR l_linestatus = 'F'")
def _(t):
    from ..operators.extract import drop_dnp

    stats = ", ".join(f"case when l_returnflag = 'R' then '0' else null end AS {s}" for s in merge_stats() if s != "fouls_committed")
    lines = t.raw("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity", "case when l_returnflag = 'R' then null else cast(l_quantity AS string) end AS minutes_decimal",
                                         "case when l_linestatus = 'F' then '1' else ' ' end AS fouls_committed", *stats.split(", "))
    return drop_dnp(lines).select("l_orderkey", "l_linenumber", "l_quantity")


# --- aliases --------------------------------------------------------------------------------------------------

add_view("b_all_aliases", ("b_games",), "SELECT DISTINCT home_team_id AS team_id, season_id, 'Equipe ' || cast(home_team_id as string) AS alias, 'link_text' AS alias_type FROM b_games")


@query("add_aliases", sql("b_all_aliases", "SELECT team_id, season_id, CASE WHEN season_id < 1998 THEN alias ELSE upper(alias) END AS alias, alias_type, CASE WHEN season_id < 1998 THEN 'unchanged' ELSE 'inserted' END AS change FROM b_all_aliases"))
def _(t):
    rows = t.games.selectExpr("home_team_id AS team_id", "season_id", "'Equipe ' || home_team_id AS alias", "'link_text' AS alias_type")
    return merge.add_aliases(rows.filter("season_id < 1998").distinct(), rows.withColumn("alias", F.upper(F.concat(F.lit(" "), "alias"))), merge.team_alias_key)


@query("add_player_aliases", sql("b_stats", "SELECT player_id, season_id, alias, alias_type, jersey_number, team_name_raw, CASE WHEN season_id < 1998 THEN 'unchanged' ELSE 'inserted' END AS change FROM"
       " (SELECT DISTINCT player_id, season_id, player_name_raw AS alias, 'stats_display_name' AS alias_type, jersey_number, 'Time ' || cast(team_id as string) AS team_name_raw FROM b_stats)"))
def _(t):
    rows = t.stats.selectExpr("player_id", "season_id", "player_name_raw AS alias", "'stats_display_name' AS alias_type", "jersey_number", "'Time ' || team_id AS team_name_raw")
    return merge.add_aliases(rows.filter("season_id < 1998").distinct(), rows, merge.player_alias_key)


# players of the merged table, their profile names, and the names and teams under which each season lists them
_SLUG_OF = "'supplier-' || lpad(cast(player_id as string), 9, '0')"
PAGE_LINK = {
    "player_slug": _SLUG_OF, "season_id": "season_id", "display_name": "case when game_id % 2 = 0 then 'Atleta ' else 'ATLETA ' end || cast(player_id % 20 as string)",
    "jersey_number": "jersey_number", "team_name_raw": "case when line_no < 4 then 'Equipe ' else 'EQUIPE ' end || cast((team_id + season_id) % 30 as string)",
    "position": "game_id * 10 + line_no",
}
add_view("b_page_players", ("b_stored_players", "b_run_players"),
         "SELECT coalesce(o.id, (SELECT max(id) FROM b_stored_players) + row_number() OVER (PARTITION BY o.id IS NULL ORDER BY slug)) AS id,"
         " coalesce(n.full_name, o.full_name) AS full_name, slug FROM b_stored_players o FULL JOIN b_run_players n USING (slug)")
add_view("b_page_links", ("b_stats",), f"SELECT {', '.join(f'{e} AS {n}' for n, e in PAGE_LINK.items())} FROM b_stats")
add_view("b_page_aliases", ("b_page_players", "b_page_links"),
         "SELECT id AS player_id, NULL::bigint AS season_id, full_name AS alias, 'full_name' AS alias_type, NULL::string AS jersey_number, NULL::string AS team_name_raw, 'player_profile' AS source, 1::bigint AS is_primary,"
         " CASE WHEN id % 2 = 0 THEN 'unchanged' ELSE 'inserted' END AS change FROM b_page_players"
         " UNION ALL SELECT id, NULL, 'S' || cast(id AS string), 'display_name', NULL, NULL, 'player_profile', 0, 'inserted' FROM b_page_players WHERE id % 3 > 0"
         " UNION ALL SELECT p.id, l.season_id, arg_min(l.display_name, l.position), 'stats_display_name', l.jersey_number, arg_min(l.team_name_raw, l.position), 'season_stats_efficiency', 0, 'inserted'"
         " FROM b_page_links l JOIN b_page_players p ON p.slug = l.player_slug GROUP BY p.id, l.season_id, lower(l.display_name), l.jersey_number, lower(l.team_name_raw)")
_IN_SEASON = "(SELECT season_id, lower(replace(alias, 'É', 'E')) AS alias, max(team_id) AS team_id FROM b_team_aliases GROUP BY ALL)"
_ANY_SEASON = "(SELECT lower(replace(alias, 'É', 'E')) AS alias, arg_max(team_id, id) AS team_id FROM b_team_aliases GROUP BY ALL)"
add_view("b_page_records", ("b_page_aliases", "b_page_players", "b_team_aliases"),
         "SELECT a.player_id, a.alias AS name, a.season_id, coalesce(s.team_id, e.team_id) AS team_id, a.jersey_number FROM b_page_aliases a"
         f" LEFT JOIN {_IN_SEASON} s ON s.season_id = a.season_id AND s.alias = lower(a.team_name_raw) LEFT JOIN {_ANY_SEASON} e ON e.alias = lower(a.team_name_raw)"
         " UNION ALL SELECT id, full_name, NULL, NULL, NULL FROM b_page_players")
add_view("b_page_requests", ("b_stats",), f"SELECT DISTINCT {REQUEST}, {s_key('player_name_raw')} AS key FROM"
         " (SELECT season_id, team_id, CASE WHEN game_id % 10 = 0 THEN 'n ' || s_name WHEN game_id % 10 = 1 THEN 'ninguém' ELSE 'atleta ' || cast(player_id % 20 as string) END AS player_name_raw,"
         " CASE WHEN line_no = 5 THEN NULL ELSE jersey_number END AS jersey_number FROM b_stats JOIN supplier ON s_suppkey = player_id)")
for _name in ("b_hits", "b_decided"):
    _text = VIEWS[_name][1]
    for _old in ("b_requests", "b_records", "b_hits"):
        _text = _text.replace(_old, _old.replace("b_", "b_page_"))
    add_view(_name.replace("b_", "b_page_"), tuple(n.replace("b_", "b_page_") for n in VIEWS[_name][0]), _text)


def _page_aliases(t):
    """(players with ids, their aliases with ``change``)."""
    stored, run = (_supplier(t, VIEWS[name][1]) for name in ("b_stored_players", "b_run_players"))
    players = cut_lineage(merge.assign_ids(merge.merge_players(stored, run), ["slug"]).select("id", "full_name", "slug"))
    profiles = players.selectExpr("slug AS player_slug", "full_name", "case when id % 3 > 0 then 'S' || id else ' ' end AS display_name")
    there = players.filter("id % 2 = 0").selectExpr(
        "id AS player_id", "cast(null AS bigint) AS season_id", "full_name AS alias", "'full_name' AS alias_type", "cast(null AS string) AS jersey_number",
        "cast(null AS string) AS team_name_raw", "'player_profile' AS source", "1L AS is_primary")
    links = t.stats.selectExpr(*[f"{e} AS {n}" for n, e in PAGE_LINK.items()])
    return players, merge.add_player_names(there, players, profiles, links)


@query("add_player_names", sql("b_page_aliases", "SELECT * FROM b_page_aliases"))
def _(t):
    return _page_aliases(t)[1]


@query("resolve_by_page_names", sql("b_page_decided", "SELECT * FROM b_page_decided"))
def _(t):
    """From pages to ids: players are merged, their names become aliases, lines are resolved by these."""
    players, aliases = _page_aliases(t)
    # the few team aliases are written out, as the planner takes them to be as many as the games
    stored = cut_lineage(aliases.drop("change"))
    records = resolve.name_records(players.select("id", "full_name"), stored, cut_lineage(_team_aliases(t)))
    names = t.raw("supplier").select(F.col("s_suppkey").alias("player_id"), "s_name")
    lines = t.stats.join(names, "player_id").selectExpr(
        "season_id", "team_id", "case when game_id % 10 = 0 then 'n ' || s_name when game_id % 10 = 1 then 'ninguém' else 'atleta ' || player_id % 20 end AS player_name_raw",
        "case when line_no = 5 then null else jersey_number end AS jersey_number")
    return resolve.resolve_requests(lines, records, tasks_for(stored))


# --- queues ------------------------------------------------------------------------------------------------------


@query("failed_queue", sql("b_failed",
       "SELECT CASE WHEN error_type = 'no_table_in_page' THEN id END AS id, game_id, CASE WHEN error_type = 'no_table_in_page' THEN error_type ELSE 'retry' END AS error_type, error_message, 'x' AS change FROM b_failed WHERE false"
       " UNION ALL SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'O' THEN 'old' ELSE 'again' END, o_orderpriority,"
       " CASE WHEN o_orderpriority <> '1-URGENT' THEN 'inserted' WHEN o_orderstatus = 'O' THEN 'updated' ELSE 'unchanged' END FROM orders WHERE (o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F') OR (o_orderpriority = '2-HIGH' AND o_orderstatus = 'O')"))
def _(t):
    orders = t.raw("orders")
    queue = orders.filter("o_orderpriority = '1-URGENT'").selectExpr("o_orderkey AS id", "o_orderkey AS game_id", "'old' AS error_type", "o_orderpriority AS error_message")
    failures = orders.filter("o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O'").selectExpr("o_orderkey AS game_id", "'again' AS error_type", "o_orderpriority AS error_message")
    done = orders.filter("o_orderstatus = 'F'").selectExpr("o_orderkey AS game_id")
    return merge.failed_queue(queue, failures, done)


def _team_only(t):
    queue = _failed(t).withColumns({"season_id": F.lit(0).cast("bigint"), "boxscore_url": F.lit(None).cast("string")}).select(
        "id", "game_id", "season_id", "boxscore_url", "error_type", "error_message")
    return merge.remove_team_only(_player_lines(t), _team_lines(t), t.games, queue)


@query("remove_team_only", sql(("b_team_lines", "b_coverage"), "SELECT game_id, team_id FROM b_team_lines WHERE game_id IS NULL OR game_id IN (SELECT id FROM b_coverage WHERE player_rows > 0)"))
def _(t):
    return _team_only(t)[0]


@query("removed_team_only", sql("b_coverage", "SELECT id AS game_id, team_rows, season_id, boxscore_url FROM b_coverage WHERE player_rows = 0 AND team_rows > 0"))
def _(t):
    return _team_only(t)[1]


@query("team_only_failures", sql("b_coverage", "SELECT CASE WHEN has_failure THEN id END AS id, id AS game_id, CASE WHEN player_rows = 0 AND team_rows > 0 THEN 'empty_boxscore_template' ELSE error_type END AS error_type,"
       " CASE WHEN NOT has_failure THEN 'inserted' WHEN player_rows = 0 AND team_rows > 0 THEN 'updated' ELSE 'unchanged' END AS change FROM b_coverage WHERE has_failure OR (player_rows = 0 AND team_rows > 0)"))
def _(t):
    return _team_only(t)[2].select("id", "game_id", "error_type", "change")


@query("run_log", sql("b_merged_games", "SELECT 'games' AS job, 'games' AS target, 'partial' AS status, count(*) AS items_found, count(*) FILTER (change = 'inserted') AS items_inserted, count(*) FILTER (change = 'updated') AS items_updated,"
       " (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS items_failed FROM b_merged_games"))
def _(t):
    return merge.run_log("games", "games", merge.merge_games(_stored_games(t), _run_games(t), READ_ORDER), _failed(t))


RUN_COUNTS = ("SELECT 1::bigint AS run_id, 'games' AS job, 'games' AS target, (SELECT cast(min(o_orderdate) AS date) FROM orders) AS started, (SELECT cast(max(o_orderdate) AS date) FROM orders) AS finished,"
              " 'partial' AS status, count(*) AS items_found, count(*) FILTER (change = 'inserted') AS items_inserted, count(*) FILTER (change = 'updated') AS items_updated,"
              " (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS items_failed FROM b_merged_games")


@query("run_history", sql("b_merged_games", f"{RUN_COUNTS} UNION ALL SELECT 2, 'lines', 'lines', (SELECT cast(max(o_orderdate) AS date) FROM orders), NULL, 'running', NULL, NULL, NULL, NULL"))
def _(t):
    """A run that is started, finished and finished again, and one that is still open."""
    dates = t.raw("orders").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi")).first()
    log = scratch_path(t.spark, "runs")
    merged = cut_lineage(merge.merge_games(_stored_games(t), _run_games(t), READ_ORDER))
    merge.start_run(t.spark, log, 1, "games", "games", dates["lo"])
    for _ in range(2):
        merge.finish_run(t.spark, log, 1, merged, _failed(t), dates["hi"])
    merge.start_run(t.spark, log, 2, "lines", "lines", dates["hi"])
    runs = merge.read_runs(t.spark, log)
    return runs.select("run_id", "job", "target", F.to_date("started_at").alias("started"), F.to_date("finished_at").alias("finished"), "status",
                       "items_found", "items_inserted", "items_updated", "items_failed")


_PLAYED = "points % 10 <> 0"


@query("remove_dnp_and_resolve", sql(("b_open_lines", "b_decided"),
       f"SELECT 'removed' AS part, game_id, points * 0 AS points, player_name_raw, NULL::bigint AS player_id, NULL AS reason, NULL::bigint AS candidates FROM b_open_lines WHERE NOT ({_PLAYED})"
       f" UNION ALL SELECT 'kept', l.game_id, l.points, l.player_name_raw, d.player_id, NULL, NULL FROM b_open_lines l JOIN b_decided d ON {SAME.format(a='l', b='d')} WHERE {_PLAYED}"
       f" UNION ALL SELECT 'queued', l.game_id, NULL, l.player_name_raw, NULL, d.reason, d.candidates FROM b_open_lines l JOIN b_decided d ON {SAME.format(a='l', b='d')}"
       f" WHERE {_PLAYED} AND d.player_id IS NULL"))
def _(t):
    zero = {c: F.expr(f"case when {_PLAYED} then points else 0 end") for c in (*merge_stats(), "minutes_decimal")}
    kept, removed, queue = merge.remove_dnp_and_resolve(t.open_lines.withColumns(zero), t.records)
    columns = ["part", "game_id", "points", "player_name_raw", "player_id", "reason", "candidates"]
    none = {"reason": F.lit(None).cast("string"), "candidates": F.lit(None).cast("bigint")}
    parts = [kept.withColumns(none | {"part": F.lit("kept")}), removed.withColumns(none | {"part": F.lit("removed")}),
             queue.withColumns({"part": F.lit("queued"), "points": F.lit(None).cast("bigint"), "player_id": F.lit(None).cast("bigint")})]
    return parts[0].select(columns).unionByName(parts[1].select(columns)).unionByName(parts[2].select(columns))


# --- applied resolutions ---------------------------------------------------------------------------------------------

_DECIDED = ("SELECT player_id, name, season_id, team_id, jersey_number FROM b_records UNION ALL SELECT s.player_id, g.player_name_raw, g.season_id, g.team_id, g.jersey_number"
            f" FROM b_groups g JOIN b_seat s USING (season_id, team_id, jersey_number) LEFT JOIN b_fit f ON {SAME.format(a='g', b='f')} WHERE s.candidates = 1 AND coalesce(f.fit, 0)")
add_view("b_applied", ("b_groups", "b_seat", "b_fit", "b_records"), f"{_DECIDED} >= 0.88")
add_view("b_reviewed", ("b_groups", "b_seat", "b_fit", "b_records"), f"{_DECIDED} < 0.88")
add_view("b_applied_hits", ("b_requests", "b_applied"),
         "SELECT r.*, c.player_id, CASE WHEN c.season_id = r.season_id AND c.team_id IS NOT DISTINCT FROM r.team_id AND c.jersey_number IS NOT DISTINCT FROM r.jersey_number THEN 1"
         " WHEN c.season_id = r.season_id AND c.team_id IS NOT DISTINCT FROM r.team_id AND c.jersey_number IS NULL THEN 2 WHEN c.season_id = r.season_id AND c.team_id IS NOT DISTINCT FROM r.team_id THEN 3"
         " WHEN c.season_id = r.season_id AND c.jersey_number IS NOT DISTINCT FROM r.jersey_number THEN 4 WHEN c.season_id = r.season_id THEN 5"
         " WHEN c.season_id IS NULL AND c.team_id IS NULL AND c.jersey_number IS NULL THEN 6 ELSE 7 END AS strategy"
         f" FROM b_requests r JOIN (SELECT *, {s_key('name')} AS key FROM b_applied) c USING (key)")
add_view("b_applied_best", ("b_applied_hits",),
         f"SELECT * FROM (SELECT {REQUEST}, strategy, count(DISTINCT player_id) AS n, min(player_id) AS pid, row_number() OVER (PARTITION BY {REQUEST} ORDER BY strategy) AS rn FROM b_applied_hits GROUP BY {REQUEST}, strategy) WHERE rn = 1")
for _name in ("b_applied_hits", "b_applied_best"):
    add_view(_name.replace("applied", "reviewed"), tuple(n.replace("applied", "reviewed") for n in VIEWS[_name][0]), VIEWS[_name][1].replace("b_applied", "b_reviewed"))


def s_applied(best):
    return ("SELECT l.game_id, l.points, l.player_name_raw, l.jersey_number, CASE WHEN d.strategy < 7 AND d.n = 1 THEN d.pid END AS player_id,"
            f" CASE WHEN {s_key('l.player_name_raw')} IS NULL THEN 'empty_player_name' WHEN d.n IS NULL THEN 'no_alias_match' WHEN d.strategy = 7 THEN 'no_safe_match' WHEN d.n = 1 THEN 'resolved' ELSE 'ambiguous_match' END AS reason"
            f" FROM b_open_lines l LEFT JOIN {best} d ON {SAME.format(a='l', b='d')}")


def _apply(t, approve, decided_by, **chosen):
    suggestions = similar.unique_jersey(_groups(t), t.stored_records, t.pool_players).withColumnRenamed("resolved_player_id", "suggested_player_id") \
        .withColumn("approved", approve)
    selected = merge.select_suggestions(suggestions, **chosen)
    lines = t.open_lines.select("game_id", "points", *resolve.REQUEST, "player_id")
    return merge.apply_resolutions(lines, selected, t.pool_players, t.pool_aliases, decided_by=decided_by).select(
        "game_id", "points", "player_name_raw", "jersey_number", "player_id", "reason")


@query("apply_resolutions", sql(("b_open_lines", "b_applied_best"), s_applied("b_applied_best")))
def _(t):
    return _apply(t, F.lit(None).cast("string"), merge.AUTOMATIC, auto=True, reviewed=False)


@query("apply_reviewed", sql(("b_open_lines", "b_reviewed_best"), s_applied("b_reviewed_best")))
def _(t):
    """A reviewer approves the only wearer of a jersey where the name alone did not decide."""
    return _apply(t, F.when(F.col("decision") == "manual", "1"), merge.REVIEWED, auto=False, reviewed=True)
