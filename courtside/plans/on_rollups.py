"""League tables, rollups, records and their parts."""

from pyspark.sql import functions as F

from ..constants import MINUTES, RECORD_STATS, STAT_INPUTS
from ..operators import positions, quality, records, rollups, standings
from .bindings import add_view, sql
from .on_functions import STAGE, WINNER, s_result
from .registry import query

# --- league tables --------------------------------------------------------------------------

add_view("b_staged", ("b_games",), f"SELECT *, {STAGE} AS stage, {WINNER} AS winner_team_id FROM b_games")
add_view("b_sides", ("b_staged",),
         "SELECT season_id, competition, stage, home_team_id AS team_id, home_team_abbr_raw AS abbr, home_score AS scored, away_score AS allowed, 1 AS home, winner_team_id FROM b_staged"
         " UNION ALL SELECT season_id, competition, stage, away_team_id, away_team_abbr_raw, away_score, home_score, 0, winner_team_id FROM b_staged")
add_view("b_abbr", ("b_sides",),
         "SELECT season_id, competition, team_id, abbr FROM (SELECT *, row_number() OVER (PARTITION BY season_id, competition, team_id ORDER BY n DESC, abbr) AS rn"
         " FROM (SELECT season_id, competition, team_id, abbr, count(*) AS n FROM b_sides WHERE stage IS NULL GROUP BY ALL)) WHERE rn = 1")
add_view("b_table", ("b_sides", "b_abbr"),
         "SELECT s.season_id, s.competition, s.team_id, count(*) AS games_played, cast(sum(cast(scored > allowed AS int)) AS bigint) AS wins,"
         " cast(sum(cast(scored > allowed AND home = 1 AS int)) AS bigint) AS home_wins, cast(sum(cast(scored <= allowed AND home = 1 AS int)) AS bigint) AS home_losses,"
         " cast(sum(cast(scored > allowed AND home = 0 AS int)) AS bigint) AS away_wins, cast(sum(cast(scored <= allowed AND home = 0 AS int)) AS bigint) AS away_losses,"
         " cast(sum(scored) AS bigint) AS points_for, cast(sum(allowed) AS bigint) AS points_against, max(a.abbr) AS team_abbr,"
         " cast(sum(cast(scored <= allowed AS int)) AS bigint) AS losses, cast(sum(scored - allowed) AS bigint) AS point_diff"
         " FROM b_sides s JOIN b_abbr a USING (season_id, competition, team_id) WHERE stage IS NULL GROUP BY s.season_id, s.competition, s.team_id")
add_view("b_champion", ("b_staged",),
         "SELECT season_id, competition, team_id, final_wins FROM (SELECT *, count(*) OVER (PARTITION BY season_id, competition, final_wins) AS equal,"
         " rank() OVER (PARTITION BY season_id, competition ORDER BY final_wins DESC) AS place FROM (SELECT season_id, competition, winner_team_id AS team_id,"
         " count(*) AS final_wins FROM b_staged WHERE stage = 'final' AND winner_team_id IS NOT NULL GROUP BY ALL)) WHERE place = 1 AND equal = 1")
LABEL = ("CASE finish_stage_order WHEN -1 THEN 'em andamento' WHEN 0 THEN 'não classificou' WHEN 3 THEN 'quartas' WHEN 4 THEN 'semifinal'"
         " WHEN 5 THEN 'vice-campeão' WHEN 6 THEN 'campeão' END")
add_view("b_finish", ("b_sides", "b_champion"),
         "SELECT r.season_id, r.competition, r.team_id, cast(CASE WHEN c.team_id IS NOT NULL THEN 6 ELSE r.reached END AS bigint) AS finish_stage_order FROM"
         " (SELECT season_id, competition, team_id, max(CASE stage WHEN 'final' THEN 5 WHEN 'semifinal' THEN 4 WHEN 'quartas' THEN 3 END) AS reached"
         " FROM b_sides WHERE stage IS NOT NULL GROUP BY ALL) r LEFT JOIN b_champion c USING (season_id, competition, team_id)")
add_view("b_standings", ("b_table", "b_finish", "b_teams", "b_seasons"),
         "SELECT *, cast(finish_stage_order > 0 AS bigint) AS qualified_playoffs, " + LABEL + " AS finish_stage, cast(finish_stage_order = 6 AS bigint) AS is_champion FROM ("
         "SELECT b.season_id, y.name AS season_name, b.competition, row_number() OVER (PARTITION BY b.season_id, b.competition ORDER BY b.wins / b.games_played DESC, b.wins DESC,"
         " b.point_diff DESC, b.points_for DESC, coalesce(t.canonical_name, ''), b.team_id) AS rank, b.team_id, t.canonical_name AS team_name, b.team_abbr,"
         " 100.0::double * b.wins / b.games_played AS ap_pct, b.games_played, b.wins, b.losses, cast(b.home_wins AS string) || '-' || cast(b.home_losses AS string) AS home_record,"
         " cast(b.away_wins AS string) || '-' || cast(b.away_losses AS string) AS away_record, b.home_wins, b.home_losses, b.away_wins, b.away_losses, b.points_for, b.points_against,"
         " b.point_diff, coalesce(f.finish_stage_order, CASE WHEN y.is_current = 1 THEN -1 ELSE 0 END) AS finish_stage_order"
         " FROM b_table b LEFT JOIN b_finish f USING (season_id, competition, team_id) LEFT JOIN b_teams t ON t.id = b.team_id LEFT JOIN b_seasons y ON y.id = b.season_id)")


@query("finished_games", sql("b_games", "SELECT id, season_id, home_team_id, away_team_id, home_score, away_score FROM b_games WHERE home_score IS NOT NULL AND away_score IS NOT NULL"))
def _(t):
    return standings.finished_games(t.games).select("id", "season_id", "home_team_id", "away_team_id", "home_score", "away_score")


@query("regular_season_games", sql("b_staged", "SELECT id, season_id, phase, round FROM b_staged WHERE stage IS NULL"))
def _(t):
    return standings.regular_season_games(t.games).select("id", "season_id", "phase", "round")


@query("postseason_games", sql("b_staged", "SELECT id, season_id, phase, stage FROM b_staged WHERE stage IS NOT NULL"))
def _(t):
    return standings.postseason_games(t.games).select("id", "season_id", "phase", "stage")


@query("regular_season_table", sql("b_table", "SELECT * FROM b_table"))
def _(t):
    return standings.regular_season_table(t.games)


@query("postseason_finish", sql("b_finish", f"SELECT season_id, competition, team_id, finish_stage_order, {LABEL} AS finish_stage FROM b_finish"))
def _(t):
    return standings.postseason_finish(t.games)


@query("season_champion", sql("b_champion", "SELECT * FROM b_champion"))
def _(t):
    return standings.season_champion(t.games)


@query("standings", sql("b_standings", "SELECT * FROM b_standings"))
def _(t):
    return t.standings


@query("standings_rank", sql("b_standings", "SELECT season_id, competition, team_id, rank FROM b_standings"))
def _(t):
    named = standings.regular_season_table(t.games).join(standings.team_names(t.teams), "team_id", "left")
    return standings.standings_rank(named).select("season_id", "competition", "team_id", "rank")


# --- rollups ----------------------------------------------------------------------------------

TOTAL = {s: rollups.total_name(s) for s in (MINUTES, *STAT_INPUTS)}


def s_sums(columns, source=None, kind="bigint"):
    return ", ".join(f"cast(sum({source[c] if source else c}) AS {'double' if TOTAL.get(c) == 'minutes_total' or c == 'minutes_total' else kind}) AS {TOTAL.get(c, c)}" for c in columns)


def s_ratios(minutes=True):
    stats = [s for s in ("minutes", "points", "rebounds", "assists", "steals", "blocks", "turnovers", "plus_minus", "efficiency") if minutes or s != "minutes"]
    means = [f"CASE WHEN games_played > 0 THEN {s}_total / games_played ELSE 0.0::double END AS {s}_per_game" for s in stats]
    shots = [f"CASE WHEN {s}_attempted > 0 THEN {s}_made / {s}_attempted END AS {s}_pct" for s in ("fg", "three", "two", "ft")]
    return ", ".join(means + shots)


add_view("b_pts_sums", ("b_stats",),
         "SELECT season_id, team_id, player_id, count(DISTINCT game_id) AS games_played, cast(sum(CASE WHEN is_starter = '1' THEN 1 ELSE 0 END) AS bigint) AS games_started,"
         f" max(player_name_raw) AS raw_name, {s_sums((MINUTES, *STAT_INPUTS))} FROM b_stats GROUP BY season_id, team_id, player_id")
add_view("b_pts", ("b_pts_sums", "b_players", "b_teams", "b_seasons"),
         "SELECT s.* EXCLUDE (raw_name), coalesce(p.full_name, p.display_name, s.raw_name) AS player_name, t.canonical_name AS team_name, y.name AS season_name, "
         + s_ratios() + " FROM b_pts_sums s LEFT JOIN b_players p ON p.id = s.player_id LEFT JOIN b_teams t ON t.id = s.team_id LEFT JOIN b_seasons y ON y.id = s.season_id")


@query("player_team_seasons", sql("b_pts", "SELECT * FROM b_pts"))
def _(t):
    return t.player_team_seasons


@query("attach_names", sql(("b_stats", "b_players", "b_teams", "b_seasons"),
       "SELECT game_id, line_no, part_id, player_id, coalesce(p.full_name, p.display_name) AS player_name, t.canonical_name AS team_name, y.name AS season_name"
       " FROM b_stats s LEFT JOIN b_players p ON p.id = s.player_id LEFT JOIN b_teams t ON t.id = s.team_id LEFT JOIN b_seasons y ON y.id = s.season_id"))
def _(t):
    return rollups.with_names(t.stats, t.players, t.teams, t.seasons).select(
        "game_id", "line_no", "part_id", "player_id", "player_name", "team_name", "season_name")


RESUM = [*["games_played", "games_started"], *rollups.PLAYER_TOTALS]
add_view("b_ps", ("b_pts",),
         "SELECT *, " + s_ratios() + " FROM (SELECT season_id, player_id, min(season_name) AS season_name, min(player_name) AS player_name, "
         + s_sums(RESUM) + ", count(*) AS teams_count, string_agg(cast(team_id AS string), '|' ORDER BY team_id) AS team_ids,"
         " coalesce(string_agg(team_name, '|' ORDER BY team_id), '') AS team_names, arg_max(team_id, games_played * 1000 - team_id) AS primary_team_id,"
         " first(team_name ORDER BY games_played DESC, team_id) AS primary_team_name FROM b_pts GROUP BY season_id, player_id)")
add_view("b_career_teams", ("b_pts",),
         "SELECT player_id, count(*) AS teams_count, string_agg(cast(team_id AS string), '|' ORDER BY first_season, team_id) AS team_ids,"
         " coalesce(string_agg(team_name, '|' ORDER BY first_season, team_id), '') AS team_names FROM (SELECT player_id, team_id, min(season_id) AS first_season, min(team_name) AS team_name"
         " FROM b_pts GROUP BY player_id, team_id) GROUP BY player_id")
add_view("b_career", ("b_pts", "b_career_teams", "b_seasons"),
         "SELECT c.*, teams_count, team_ids, team_names, a.name AS first_season_name, z.name AS last_season_name, " + s_ratios()
         + " FROM (SELECT player_id, min(player_name) AS player_name, min(season_id) AS first_season_id, max(season_id) AS last_season_id,"
         " count(DISTINCT season_id) AS seasons_count, " + s_sums(RESUM) + " FROM b_pts GROUP BY player_id) c JOIN b_career_teams USING (player_id)"
         " LEFT JOIN b_seasons a ON a.id = first_season_id LEFT JOIN b_seasons z ON z.id = last_season_id")


@query("player_seasons", sql("b_ps", "SELECT * FROM b_ps"))
def _(t):
    return t.player_seasons


@query("player_career_totals", sql("b_career", "SELECT * FROM b_career"))
def _(t):
    return t.career


add_view("b_ts", ("b_team_stats", "b_standings", "b_teams", "b_seasons"),
         "SELECT s.*, r.rank, r.ap_pct, r.wins, r.losses, r.home_record, r.away_record, r.finish_stage, r.is_champion, r.points_against, r.point_diff,"
         " t.canonical_name AS team_name, y.name AS season_name, " + s_ratios(False).replace("games_played", "s.games_played")
         + f" FROM (SELECT season_id, competition, team_id, count(DISTINCT game_id) AS games_played, {s_sums(STAT_INPUTS)} FROM b_team_stats GROUP BY ALL) s"
         " LEFT JOIN b_standings r USING (season_id, competition, team_id) LEFT JOIN b_teams t ON t.id = s.team_id LEFT JOIN b_seasons y ON y.id = s.season_id")


@query("team_seasons", sql("b_ts", "SELECT * FROM b_ts"))
def _(t):
    return t.team_seasons


@query("team_seasons_with_standings", sql("b_ts", "SELECT season_id, competition, team_id, rank, wins, losses, finish_stage, point_diff FROM b_ts"))
def _(t):
    return t.team_seasons.select("season_id", "competition", "team_id", "rank", "wins", "losses", "finish_stage", "point_diff")


@query("skipped_rows", "SELECT CASE WHEN l_returnflag = 'R' THEN 'missing_player_id' WHEN l_linestatus = 'O' THEN 'missing_team_id'"
       " WHEN l_linenumber = 7 THEN 'missing_season_id' END AS reason, count(*) AS rows FROM lineitem"
       " WHERE l_returnflag = 'R' OR l_linestatus = 'O' OR l_linenumber = 7 GROUP BY 1")
def _(t):
    lines = t.raw("lineitem").selectExpr(
        "case when l_returnflag <> 'R' then l_suppkey end AS player_id", "case when l_linestatus <> 'O' then l_orderkey % 30 end AS team_id",
        "case when l_linenumber <> 7 then 1992 end AS season_id")
    return rollups.skipped_rows(lines)


@query("most_common", "SELECT c_mktsegment, nation FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, nation) AS rn FROM (SELECT c_mktsegment, n_name AS nation, count(*) AS n"
       " FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)) WHERE rn = 1")
def _(t):
    rows = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rollups.most_common(rows, ["c_mktsegment"], "n_name", "nation")


@query("ordered_ids", sql("b_stats", "SELECT player_id, string_agg(cast(team_id AS string), '|' ORDER BY first_season, team_id) AS team_ids, count(*) AS teams_count"
       " FROM (SELECT player_id, team_id, min(season_id) AS first_season FROM b_stats GROUP BY ALL) GROUP BY player_id"))
def _(t):
    return rollups.ordered_ids(t.stats, ["player_id"], F.col("season_id"), "team_id")


AVERAGED = ("minutes", "points", "rebounds", "assists", "steals", "blocks", "turnovers", "efficiency")


@query("career_averages", sql("b_ps", "SELECT player_id, cast(sum(games_played) AS bigint) AS games_played, "
       + ", ".join(f"sum({s}_total) / sum(games_played) AS {s}_avg" for s in AVERAGED) + " FROM b_ps GROUP BY player_id"))
def _(t):
    return rollups.career_averages(t.player_seasons)


@query("season_averages", sql("b_ts", "SELECT season_id, competition, team_id, wins + losses AS games, "
       + ", ".join(f"CASE WHEN wins + losses > 0 THEN {c} / (wins + losses) END AS {c}_avg" for c in rollups.TEAM_TOTALS) + " FROM b_ts"))
def _(t):
    return rollups.season_averages(t.team_seasons, ["season_id", "competition", "team_id"], F.col("wins") + F.col("losses"))


@query("player_season_averages", sql("b_ps", "SELECT season_id, player_id, games_played AS games, "
       + ", ".join(f"CASE WHEN games_played > 0 THEN {c} / games_played END AS {c}_avg" for c in rollups.PLAYER_TOTALS) + " FROM b_ps"))
def _(t):
    return rollups.season_averages(t.player_seasons, ["season_id", "player_id"], F.col("games_played"))


# --- records -------------------------------------------------------------------------------------

_LABELS = "CASE record_type " + " ".join(f"WHEN '{s}' THEN '{label}'" for s, label in RECORD_STATS) + " END"
_LONG = " UNION ALL ".join(
    f"SELECT player_id, season_id, '{s}' AS record_type, cast({s} AS double) AS value, game_date, game_id, team_id, home_team_id, away_team_id, home_score, away_score FROM b_dated"
    for s, _ in RECORD_STATS)
add_view("b_dated", ("b_stats", "b_games"),
         "SELECT s.*, g.game_date, g.home_team_id, g.away_team_id, g.home_score, g.away_score FROM b_stats s LEFT JOIN b_games g ON g.id = s.game_id")
add_view("b_long", ("b_dated",), _LONG)
add_view("b_best", ("b_long",),
         "SELECT *, count(*) OVER w AS tie_count, row_number() OVER (PARTITION BY player_id, scope, scope_season, record_type, value ORDER BY game_date DESC, game_id DESC, team_id DESC) AS rn,"
         " max(value) OVER (PARTITION BY player_id, scope, scope_season, record_type) AS top FROM"
         " (SELECT *, 'career' AS scope, cast(NULL AS bigint) AS scope_season FROM b_long UNION ALL SELECT *, 'season', season_id FROM b_long)"
         " WINDOW w AS (PARTITION BY player_id, scope, scope_season, record_type, value)")
add_view("b_records_out", ("b_best", "b_players", "b_teams", "b_seasons"),
         f"SELECT b.player_id, scope, scope_season AS season_id, record_type, {_LABELS} AS record_label, value, tie_count, game_id, game_date, team_id,"
         " CASE WHEN team_id = home_team_id THEN 'home' ELSE 'away' END AS home_away,"
         " CASE WHEN team_id = home_team_id THEN away_team_id ELSE home_team_id END AS opponent_team_id,"
         " CASE WHEN team_id = home_team_id THEN home_score ELSE away_score END AS team_score,"
         " CASE WHEN team_id = home_team_id THEN away_score ELSE home_score END AS opponent_score,"
         f" CASE WHEN team_id = home_team_id THEN {s_result('home_score', 'away_score')} ELSE {s_result('away_score', 'home_score')} END AS result,"
         " coalesce(p.full_name, p.display_name) AS player_name, t.canonical_name AS team_name, y.name AS season_name,"
         " (SELECT o.canonical_name FROM b_teams o WHERE o.id = CASE WHEN b.team_id = b.home_team_id THEN b.away_team_id ELSE b.home_team_id END) AS opponent_team_name"
         " FROM b_best b LEFT JOIN b_players p ON p.id = b.player_id LEFT JOIN b_teams t ON t.id = b.team_id LEFT JOIN b_seasons y ON y.id = b.scope_season WHERE rn = 1 AND value = top")


def _records(t):
    return records.player_records(t.stats, t.games, t.players, t.teams, t.seasons)


@query("player_records", sql("b_records_out", "SELECT * FROM b_records_out"))
def _(t):
    return _records(t)


@query("records_with_games", sql("b_records_out", "SELECT player_id, season_id, record_type, game_id, game_date, home_away, opponent_team_id, team_score, opponent_score, result FROM b_records_out WHERE scope = 'season'"))
def _(t):
    return _records(t).filter("scope = 'season'").select(
        "player_id", "season_id", "record_type", "game_id", "game_date", "home_away", "opponent_team_id", "team_score", "opponent_score", "result")


@query("records_union", sql("b_records_out", "SELECT scope, record_type, count(*) AS rows, sum(value) AS total FROM b_records_out GROUP BY scope, record_type"))
def _(t):
    return _records(t).groupBy("scope", "record_type").agg(F.count("*").alias("rows"), F.sum("value").alias("total"))


# --- numbering ---------------------------------------------------------------------------------------


@query("surrogate_id", sql("b_pts_sums", "SELECT row_number() OVER (ORDER BY season_id, team_id, player_id) AS id, season_id, team_id, player_id, games_played FROM b_pts_sums"))
def _(t):
    lines = t.stats.repartition(t.line_tasks, "season_id", "team_id", "player_id")
    rows = lines.groupBy("season_id", "team_id", "player_id").agg(F.count_distinct("game_id").alias("games_played"))
    return positions.with_surrogate_id(rows, ["season_id", "team_id", "player_id"], tasks=t.line_tasks)


@query("dedupe_first", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def _(t):
    return positions.first_per_group(t.raw("events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("team_totals_by_game", sql("b_team_stats", "SELECT * FROM b_team_stats"))
def _(t):
    return t.team_stats


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return quality.duplicate_keys(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])
