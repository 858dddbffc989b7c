"""Data-quality reports.

Coverage is made uneven on purpose: player lines are those shipped before a date,
team lines those of returned or accepted items, failures are urgent orders.
"""

from pyspark.sql import functions as F

from ..operators import quality
from . import on_rollups  # noqa: F401  (defines shared views)
from .bindings import add_view, sql
from .registry import query

add_view("b_player_lines", (), "SELECT CASE WHEN l_shipdate < TIMESTAMP '1997-01-01 00:00:00' THEN l_orderkey END AS game_id FROM lineitem")
add_view("b_team_lines", ("b_games",), "SELECT DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_orderkey END AS game_id, CASE WHEN l_linenumber % 2 = 0 THEN home_team_id ELSE away_team_id END AS team_id"
         " FROM lineitem JOIN b_games ON id = l_orderkey")
add_view("b_failed", (), "SELECT o_orderkey AS id, o_orderkey AS game_id, CASE WHEN o_custkey % 2 = 0 THEN 'no_table_in_page' ELSE 'empty_html' END AS error_type,"
         " 'order ' || o_orderpriority AS error_message FROM orders WHERE o_orderpriority = '1-URGENT'")
add_view("b_coverage", ("b_games", "b_player_lines", "b_team_lines", "b_failed"),
         "SELECT g.*, coalesce(p.n, 0) AS player_rows, coalesce(t.n, 0) AS team_rows, f.error_type, f.error_message, f.game_id IS NOT NULL AS has_failure FROM b_games g"
         " LEFT JOIN (SELECT game_id, count(*) AS n FROM b_player_lines GROUP BY 1) p ON p.game_id = g.id"
         " LEFT JOIN (SELECT game_id, count(*) AS n FROM b_team_lines GROUP BY 1) t ON t.game_id = g.id LEFT JOIN b_failed f ON f.game_id = g.id")


def _player_lines(t):
    """All lines; the game of the later ones is not known."""
    return t.raw("lineitem").selectExpr("case when l_shipdate < timestamp_ntz '1997-01-01 00:00:00' then l_orderkey end AS game_id")


def _team_lines(t):
    lines = t.raw("lineitem").join(t.games, F.col("id") == F.col("l_orderkey"))
    return lines.selectExpr("case when l_returnflag <> 'N' then l_orderkey end AS game_id", "case when l_linenumber % 2 = 0 then home_team_id else away_team_id end AS team_id").distinct()


def _failed(t):
    return t.raw("orders").filter("o_orderpriority = '1-URGENT'").selectExpr(
        "o_orderkey AS id", "o_orderkey AS game_id", "case when o_custkey % 2 = 0 then 'no_table_in_page' else 'empty_html' end AS error_type",
        "'order ' || o_orderpriority AS error_message")


def _parts(t):
    return t.games, _player_lines(t), _team_lines(t), _failed(t)


_STATUS = "CASE WHEN player_rows > 0 AND team_rows = 2 THEN 'success' WHEN has_failure THEN 'failed' WHEN boxscore_url IS NULL THEN 'no_boxscore_url' ELSE 'unknown' END"
add_view("b_status", ("b_coverage",),
         f"SELECT id AS game_id, season_id, competition, game_date, home_score, away_score, boxscore_url, {_STATUS} AS status,"
         " cast(player_rows > 0 AND team_rows = 2 AS bigint) AS has_boxscore_stats, team_rows AS team_game_stats_rows, cast(player_rows > 0 AS bigint) AS has_player_game_stats,"
         f" CASE {_STATUS} WHEN 'failed' THEN error_type WHEN 'no_boxscore_url' THEN 'missing_boxscore_url' WHEN 'unknown' THEN 'not_processed_or_inconsistent' END AS error_type,"
         f" CASE {_STATUS} WHEN 'failed' THEN error_message END AS error_message FROM b_coverage")


@query("boxscore_status", sql("b_status", "SELECT * FROM b_status"))
def _(t):
    return quality.boxscore_status(*_parts(t))


@query("boxscore_status_report", sql("b_status", "SELECT status, count(*) AS games FROM b_status GROUP BY status"))
def _(t):
    return quality.boxscore_status_report(quality.boxscore_status(*_parts(t)))


@query("boxscore_unknowns", sql("b_coverage", "SELECT id AS game_id, season_id, game_date, home_score, away_score, player_rows, team_rows, boxscore_url FROM b_coverage"
       " WHERE boxscore_url IS NOT NULL AND NOT has_failure AND NOT (player_rows > 0 AND team_rows = 2)"))
def _(t):
    return quality.boxscore_unknowns(*_parts(t))


@query("only_failed", sql(("b_games", "b_failed"), "SELECT id, phase FROM b_games WHERE id IN (SELECT game_id FROM b_failed)"))
def _(t):
    return quality.only_failed(t.games, _failed(t)).select("id", "phase")


@query("team_only_games", sql("b_coverage", "SELECT id AS game_id, team_rows FROM b_coverage WHERE team_rows > 0 AND player_rows = 0"))
def _(t):
    return quality.team_only_games(_player_lines(t), _team_lines(t))


_INCOMPLETE = "SELECT id AS game_id, team_rows AS team_stats_rows, season_id, home_team_id, away_team_id, boxscore_url FROM b_coverage WHERE player_rows > 0 AND team_rows <> 2"


@query("incomplete_team_stats", sql("b_coverage", _INCOMPLETE))
def _(t):
    return quality.incomplete_team_stats(t.games, _player_lines(t), _team_lines(t))


@query("count_by", "SELECT event_type, count(*) AS rows FROM events GROUP BY event_type")
def _(t):
    return quality.count_by(t.raw("events"), "event_type")


_BUYER = "case when o_totalprice > 400000 then o_custkey else -o_custkey end"
_MEMBER = "case when c_acctbal > 0 then c_custkey else -c_custkey end"


@query("key_diff", f"SELECT coalesce(e.k, a.k) AS o_custkey, CASE WHEN a.k IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT DISTINCT {_BUYER} AS k FROM orders) e"
       f" FULL JOIN (SELECT DISTINCT {_MEMBER} AS k FROM customer) a USING (k) WHERE e.k IS NULL OR a.k IS NULL")
def _(t):
    expected = t.raw("orders").selectExpr(f"{_BUYER} AS o_custkey")
    return quality.key_diff(expected, t.raw("customer").selectExpr(f"{_MEMBER} AS o_custkey"), ["o_custkey"])


@query("check_player_team_seasons", sql(("b_stats", "b_pts_sums"),
       "SELECT 'resolved_lines' AS \"check\", count(*) AS rows FROM b_stats UNION ALL SELECT 'expected_groups', count(*) FROM (SELECT DISTINCT season_id, team_id, player_id FROM b_stats)"
       " UNION ALL SELECT 'rollup_rows', count(*) FROM b_pts_sums UNION ALL SELECT * FROM (VALUES ('duplicates', 0), ('missing', 0), ('extra', 0), ('empty_required', 0), ('ok', 1))"))
def _(t):
    return quality.check_player_team_seasons(t.stats, t.player_team_seasons, t.line_tasks)


@query("check_standings", sql("b_standings",
       "SELECT season_id, competition, count(*) AS teams, count(*) AS rows, 0::bigint AS duplicates, 0::bigint AS empty_required, cast(sum(is_champion) AS bigint) AS champions,"
       " min(CASE WHEN is_champion = 1 THEN team_name END) AS champion_name, cast(sum(cast(finish_stage = 'semifinal' AS int)) AS bigint) AS semifinalists,"
       " cast(sum(cast(finish_stage = 'vice-campeão' AS int)) AS bigint) AS runners_up, cast(sum(cast(finish_stage = 'não classificou' AS int)) AS bigint) AS not_qualified"
       " FROM b_standings GROUP BY season_id, competition"))
def _(t):
    return quality.check_standings(t.standings)


def _unresolved(t):
    return t.raw("lineitem").filter("l_returnflag = 'R'").selectExpr(
        "l_orderkey AS game_id", "case when l_linenumber <= 2 then 'ambiguous_match' else 'no_safe_match' end AS reason")


@query("check_boxscores", sql(("b_games", "b_player_lines", "b_team_lines", "b_failed", "b_coverage"),
       "SELECT 'total' AS section, 'games' AS item, count(*) AS rows FROM b_games UNION ALL SELECT 'total', 'player_lines', count(*) FROM b_player_lines"
       " UNION ALL SELECT 'total', 'team_lines', count(*) FROM b_team_lines UNION ALL SELECT 'total', 'failed', count(*) FROM b_failed"
       " UNION ALL SELECT 'total', 'unresolved', count(*) FROM lineitem WHERE l_returnflag = 'R'"
       f" UNION ALL SELECT 'total', 'incomplete_team_stats', count(*) FROM ({_INCOMPLETE})"
       " UNION ALL SELECT 'failed_by_type', error_type, count(*) FROM b_failed GROUP BY error_type"
       " UNION ALL SELECT 'unresolved_by_reason', CASE WHEN l_linenumber <= 2 THEN 'ambiguous_match' ELSE 'no_safe_match' END, count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 2"))
def _(t):
    return quality.check_boxscores(t.games, _player_lines(t), _team_lines(t), _failed(t), _unresolved(t))


_TABLES = ("seasons", "teams", "players", "games", "player_game_stats", "team_game_stats", "player_aliases")
_SQL_OF = {"seasons": "b_seasons", "teams": "b_teams", "players": "b_players", "games": "b_games", "player_game_stats": "b_stats",
           "team_game_stats": "b_team_stats", "player_aliases": "b_nicknames"}
_ABSENT = ("team_aliases", "standings", "team_seasons", "player_team_seasons", "player_seasons", "player_career_totals", "player_records", "awards", "team_titles")
_COUNTS = " UNION ALL ".join(
    [f"SELECT '{name}' AS table_name, count(*) AS rows FROM {view}" for name, view in _SQL_OF.items()]
    + [f"SELECT '{name}', -1" for name in _ABSENT])


def _tables(t):
    return {"seasons": t.seasons, "teams": t.teams, "players": t.players, "games": t.games, "player_game_stats": t.stats,
            "team_game_stats": t.team_stats, "player_aliases": t.nicknames}


@query("table_counts", sql(tuple(_SQL_OF.values()), _COUNTS))
def _(t):
    from ..sources.tables import table_counts

    return table_counts(_tables(t), t.spark)


@query("validate_core_tables", sql(tuple(_SQL_OF.values()), f"SELECT table_name, rows, CASE WHEN rows < 0 THEN 'missing' ELSE 'ok' END AS state FROM ({_COUNTS})"))
def _(t):
    return quality.validate_core_tables(_tables(t), t.spark)
