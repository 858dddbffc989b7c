"""Filters, lists, rankings, search and the games of players."""

from pyspark.sql import functions as F

from ..operators import query as q
from ..operators import rollups
from . import on_rollups  # noqa: F401  (defines shared views)
from .bindings import add_view, sql
from .registry import query

UNIQUE = ("line_no", "part_id", "points", "player_id")
LINE = "game_id, line_no, part_id, player_id, points"
LINE_COLUMNS = ["game_id", "line_no", "part_id", "player_id", "points"]
KEY = ["season_id", "competition", "team_id"]
PLAYER = 7

# --- filters ------------------------------------------------------------------------------


@query("equality_filters", sql("b_stats", f"SELECT {LINE} FROM b_stats WHERE season_id = 1995 AND team_id = 3"))
def _(t):
    return q.equality_filters(t.stats, season_id=1995, team_id=3, game_id=None, no_such_column=1).select(*LINE_COLUMNS)


@query("text_search", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'tion') OR contains(lower(source), 'tion')")
def _(t):
    return q.text_search(t.raw("documents"), " Tion ", ("text", "source", "title")).select("doc_id", "lang")


@query("text_search_ignoring_accents", "SELECT doc_id, lang FROM documents WHERE contains(strip_accents(lower(text)), 'eaue')")
def _(t):
    return q.text_search(t.raw("documents"), "êàue", ("text",), ignore_accents=True).select("doc_id", "lang")


@query("min_games", sql("b_ps", "SELECT season_id, player_id, games_played FROM b_ps WHERE games_played >= 80"))
def _(t):
    return q.min_games(t.player_seasons, 80).select("season_id", "player_id", "games_played")


@query("metric_present", sql("b_games", "SELECT id, boxscore_url FROM b_games WHERE boxscore_url IS NOT NULL"))
def _(t):
    return q.metric_present(t.games, "boxscore_url").select("id", "boxscore_url")


@query("team_games", sql("b_games", "SELECT id, home_team_id, away_team_id FROM b_games WHERE home_team_id = 4 OR away_team_id = 4"))
def _(t):
    return q.team_games(t.games, 4).select("id", "home_team_id", "away_team_id")


@query("active_in_season", sql("b_teams", "SELECT id, canonical_name FROM b_teams WHERE 1996 BETWEEN first_seen_season_id AND last_seen_season_id"))
def _(t):
    return q.active_in_season(t.teams, 1996).select("id", "canonical_name")


@query("active_teams", sql("b_teams", "SELECT id, canonical_name FROM b_teams WHERE last_seen_season_id >= 1998"))
def _(t):
    return q.active_teams(t.teams, 1998).select("id", "canonical_name")


add_view("b_current", ("b_players", "b_ps", "b_teams"),
         "SELECT p.*, s.primary_team_id AS current_team_id, t.canonical_name AS current_team_name FROM b_players p"
         " JOIN b_ps s ON s.player_id = p.id AND s.season_id = 1998 JOIN b_teams t ON t.id = s.primary_team_id")


@query("players_current_team", sql("b_current", "SELECT id, full_name, slug, current_team_id, current_team_name FROM b_current"))
def _(t):
    return q.players_current_team(t.players, t.player_seasons, t.teams, 1998).select(
        "id", "full_name", "slug", "current_team_id", "current_team_name")


@query("player_details", sql(("b_players", "b_ps", "b_teams"),
       "SELECT p.id, p.slug, s.primary_team_id AS current_team_id, t.canonical_name AS current_team_name, '/escudos/' || t.slug AS current_team_logo_url FROM b_players p"
       " LEFT JOIN b_ps s ON s.player_id = p.id AND s.season_id = 1998 LEFT JOIN b_teams t ON t.id = s.primary_team_id"))
def _(t):
    teams = t.teams.withColumn("logo_url", F.concat(F.lit("/escudos/"), "slug"))
    return q.players_current_team(t.players, t.player_seasons, teams, 1998, how="left").select(
        "id", "slug", "current_team_id", "current_team_name", "current_team_logo_url")


@query("players_by_current_team", sql("b_current", "SELECT id, slug FROM b_current WHERE current_team_id = 2"))
def _(t):
    now = q.players_current_team(t.players, t.player_seasons, t.teams, 1998)
    return q.players_by_current_team(now, 2).select("id", "slug")


@query("list_players", sql("b_current", "SELECT id, display_name, current_team_name FROM b_current WHERE contains(lower(display_name), 's1')"
       " OR contains(lower(full_name), 's1') OR contains(lower(slug), 's1') ORDER BY display_name NULLS FIRST, full_name NULLS FIRST, id LIMIT 50"))
def _(t):
    return q.list_players(t.players, t.player_seasons, t.teams, 1998, "S1").select("id", "display_name", "current_team_name")


@query("latest_season_games", sql("b_stats", f"SELECT {LINE} FROM b_stats JOIN (SELECT player_id, max(season_id) AS season_id FROM b_stats GROUP BY 1) USING (player_id, season_id)"))
def _(t):
    last = t.stats.groupBy(F.col("player_id").alias("id")).agg(F.max("season_id").alias("last_seen_season_id"))
    return q.latest_season_games(t.stats, last).select(*LINE_COLUMNS)


@query("has_boxscore_url", sql("b_games", "SELECT id, boxscore_url FROM b_games WHERE boxscore_url IS NOT NULL ORDER BY id LIMIT 500"))
def _(t):
    return q.has_boxscore_url(t.games, 500).select("id", "boxscore_url")


# --- pages of rows -----------------------------------------------------------------------------


@query("paginate", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000 OFFSET 20")
def _(t):
    return q.paginate(t.raw("orders"), [F.desc("o_totalprice"), "o_orderkey"], 5000, 20).select("o_orderkey", "o_totalprice")


@query("paginate_total", "SELECT count(*) AS total FROM customer WHERE contains(lower(c_name), '99')")
def _(t):
    return q.total_rows(q.text_search(t.raw("customer"), "99", ("c_name",)))


@query("order_existing", sql("b_players", "SELECT id, slug FROM b_players ORDER BY full_name NULLS FIRST, id LIMIT 30"))
def _(t):
    return q.list_rows(t.players, order=("name", "full_name"), limit=30).select("id", "slug")


@query("list_standings", sql("b_standings", "SELECT season_id, competition, rank, team_id, wins FROM b_standings WHERE season_id = 1998 ORDER BY season_id, competition, rank, team_id LIMIT 50"))
def _(t):
    return q.list_standings(t.standings, season_id=1998).select("season_id", "competition", "rank", "team_id", "wins")


@query("list_seasons", sql("b_seasons", "SELECT id, name, start_date, end_date, is_current FROM b_seasons ORDER BY start_year, id LIMIT 50"))
def _(t):
    return q.list_seasons(t.seasons).select("id", "name", "start_date", "end_date", "is_current")


@query("list_teams", sql("b_teams", "SELECT id, canonical_name, slug FROM b_teams WHERE contains(lower(canonical_name), 'nation_1') OR contains(lower(slug), 'nation_1') ORDER BY canonical_name, id"))
def _(t):
    return q.list_teams(t.teams, "nation_1").select("id", "canonical_name", "slug")


@query("list_games", sql("b_games", "SELECT id, game_date, season_id FROM b_games WHERE season_id = 1995 AND (home_team_id = 3 OR away_team_id = 3) ORDER BY game_date DESC, id DESC LIMIT 50 OFFSET 5"))
def _(t):
    return q.list_games(t.games, 1995, 3, offset=5).select("id", "game_date", "season_id")


@query("row_by_id", sql("b_games", "SELECT * FROM b_games WHERE id = 42"))
def _(t):
    return q.row_by_id(t.games, 42)


@query("rows_by_foreign_id", sql("b_ps", "SELECT season_id, player_id, games_played, points_total FROM b_ps WHERE player_id = 7 ORDER BY season_id LIMIT 50"))
def _(t):
    return q.rows_by_foreign_id(t.player_seasons, "player_id", PLAYER, ("season_id",), ()).select(
        "season_id", "player_id", "games_played", "points_total")


@query("game_stats", sql("b_stats", f"SELECT {LINE}, team_id FROM b_stats WHERE game_id = 100 ORDER BY team_id, player_id, line_no, part_id, points LIMIT 50"))
def _(t):
    return q.game_stats(t.stats, 100, UNIQUE).select(*LINE_COLUMNS, "team_id")


@query("standings_by_wins", sql("b_standings", "SELECT season_id, competition, team_id, wins FROM b_standings"))
def _(t):
    return q.standings_by_wins(t.standings).select("season_id", "competition", "team_id", "wins")


@query("sample_head", sql("b_games", "SELECT id, phase FROM b_games WHERE boxscore_url IS NULL ORDER BY id LIMIT 100"))
def _(t):
    return q.sample_head(t.games.filter("boxscore_url IS NULL"), ["id"], 100).select("id", "phase")


# --- games of players -----------------------------------------------------------------------------

NEWEST = "game_date DESC, game_time DESC, game_id DESC, line_no, part_id, points, player_id"
add_view("b_player_games", ("b_stats", "b_games"),
         "SELECT s.*, g.game_date, g.game_time, g.home_team_id, g.away_team_id, g.home_score, g.away_score FROM b_stats s LEFT JOIN b_games g ON g.id = s.game_id")


@query("player_games", sql("b_player_games", f"SELECT {LINE}, game_date, home_score, away_score FROM b_player_games WHERE player_id = {PLAYER} ORDER BY {NEWEST} LIMIT 50 OFFSET 10"))
def _(t):
    return q.list_player_games(t.stats, t.games, PLAYER, UNIQUE, offset=10).select(*LINE_COLUMNS, "game_date", "home_score", "away_score")


@query("recent_player_games", sql("b_player_games", f"SELECT {LINE}, game_date FROM b_player_games WHERE player_id = {PLAYER} ORDER BY {NEWEST} LIMIT 5"))
def _(t):
    return q.recent_player_games(t.stats, t.games, PLAYER, UNIQUE).select(*LINE_COLUMNS, "game_date")


@query("recent_games_of_all_players", sql("b_player_games", f"SELECT {LINE}, game_date, game_position FROM (SELECT *, cast(row_number() OVER (PARTITION BY player_id ORDER BY {NEWEST}) AS int) AS game_position FROM b_player_games) WHERE game_position <= 5"))
def _(t):
    return q.newest_lines_per_player(t.stats, t.games, 5, UNIQUE).select(*LINE_COLUMNS, "game_date", "game_position")


@query("top_player_games", sql("b_player_games", f"SELECT {LINE}, cast(total_rebounds AS double) AS ranking_value FROM b_player_games WHERE player_id = {PLAYER} ORDER BY total_rebounds DESC, {NEWEST} LIMIT 8"))
def _(t):
    return q.top_player_games(t.stats, t.games, PLAYER, "rebounds", UNIQUE, 8).select(*LINE_COLUMNS, "ranking_value")


@query("head_to_head", sql("b_player_games", f"SELECT {LINE}, h2h_date FROM b_player_games s JOIN (SELECT DISTINCT a.game_id, a.game_date AS h2h_date FROM b_player_games a JOIN b_player_games b USING (game_id)"
       f" WHERE a.player_id = {PLAYER} AND b.player_id = 8 AND a.team_id <> b.team_id ORDER BY h2h_date DESC, game_id DESC LIMIT 5) USING (game_id) WHERE player_id IN ({PLAYER}, 8)"))
def _(t):
    return q.head_to_head(t.stats, t.games, PLAYER, 8).select(*LINE_COLUMNS, "h2h_date")


@query("games_count", sql("b_stats", f"SELECT count(DISTINCT game_id) AS games_count FROM b_stats WHERE player_id = {PLAYER}"))
def _(t):
    return q.games_count(t.stats.filter(F.col("player_id") == PLAYER))


@query("game_context", sql(("b_player_games", "b_players", "b_teams"),
       f"SELECT {LINE}, p.full_name AS entity_player_name, t.canonical_name AS entity_team_name, o.canonical_name AS entity_opponent_team_name, o.slug AS entity_opponent_team_slug,"
       " game_date AS game_game_date, home_score AS game_home_score FROM b_player_games s LEFT JOIN b_players p ON p.id = s.player_id LEFT JOIN b_teams t ON t.id = s.team_id LEFT JOIN b_teams o ON o.id = s.opponent_team_id"))
def _(t):
    return q.game_context(t.stats, t.players, t.teams, t.games).select(
        *LINE_COLUMNS, "entity_player_name", "entity_team_name", "entity_opponent_team_name", "entity_opponent_team_slug",
        "game_game_date", "game_home_score")


# --- rankings ----------------------------------------------------------------------------------------


@query("rank_by_metric", sql("b_ps", "SELECT season_id, player_id, points_per_game, cast(points_per_game AS double) AS ranking_value FROM b_ps WHERE season_id = 1995 AND games_played >= 60 ORDER BY points_per_game DESC, player_id LIMIT 20 OFFSET 3"))
def _(t):
    return q.rank_by_metric(t.player_seasons, "points_per_game", ["player_id"], season_id=1995, games=60, limit=20, offset=3).select(
        "season_id", "player_id", "points_per_game", "ranking_value")


@query("ranking_context", sql(("b_ps", "b_players", "b_teams"),
       "SELECT season_id, player_id, primary_team_id, assists_total, coalesce(p.display_name, p.full_name) AS player_name, p.slug AS player_slug, t.canonical_name AS team_name, t.slug AS team_slug, primary_team_id AS team_id"
       " FROM b_ps s LEFT JOIN b_players p ON p.id = s.player_id LEFT JOIN b_teams t ON t.id = s.primary_team_id ORDER BY assists_total DESC, season_id, player_id LIMIT 50"))
def _(t):
    top = q.rank_by_metric(t.player_seasons, "assists_total", ["season_id", "player_id"]).drop("ranking_value")
    return q.ranking_context(top, t.players, t.teams).select(
        "season_id", "player_id", "primary_team_id", "assists_total", "player_name", "player_slug", "team_name", "team_slug", "team_id")


@query("leaderboard", sql("b_ps", "SELECT player_id, efficiency_per_game FROM b_ps WHERE season_id = 1998 ORDER BY efficiency_per_game DESC, player_id LIMIT 3"))
def _(t):
    return q.leaderboard(t.player_seasons, "efficiency_per_game", 1998, ["player_id"]).select("player_id", "efficiency_per_game")


HISTORY = [c for c in sorted([*rollups.TEAM_TOTALS, "rank", "wins", "losses", "games_played", "points_against", "point_diff", "is_champion"])]


@query("team_history_ranking", sql(("b_ts", "b_teams"),
       "SELECT h.*, t.canonical_name AS team_name FROM (SELECT team_id, count(*) AS seasons_count, cast(sum(wins) AS double) AS ranking_value, string_agg(cast(season_id AS string), '|' ORDER BY cast(season_id AS string)) AS season_ids, "
       + ", ".join(f"cast(sum({c}) AS double) AS {c}_total" for c in HISTORY) + " FROM b_ts GROUP BY team_id) h LEFT JOIN b_teams t ON t.id = h.team_id ORDER BY ranking_value DESC, team_id LIMIT 10"))
def _(t):
    ranked = q.team_history_ranking(t.team_seasons, t.teams, "wins", 10)
    return ranked.select("team_id", "seasons_count", "ranking_value", "season_ids", "team_name", *[f"{c}_total" for c in HISTORY])


@query("latest_game_mvp", sql("b_player_games", f"SELECT {LINE}, game_date, efficiency FROM b_player_games WHERE game_id = (SELECT id FROM b_games ORDER BY game_date DESC, id DESC LIMIT 1) ORDER BY efficiency DESC, points DESC, line_no, part_id, player_id LIMIT 1"))
def _(t):
    return q.latest_game_mvp(t.games, t.stats, ["line_no", "part_id", "player_id"]).select(*LINE_COLUMNS, "game_date", "efficiency")


# --- search -------------------------------------------------------------------------------------------


@query("global_search", sql(("b_players", "b_teams", "b_games", "b_seasons"),
       "(SELECT 'players' AS \"group\", id, coalesce(full_name, slug) AS label FROM b_players WHERE contains(lower(full_name), '9') OR contains(lower(slug), '9') OR contains(lower(position), '9') ORDER BY full_name NULLS FIRST, id LIMIT 7)"
       " UNION ALL (SELECT 'teams', id, coalesce(canonical_name, slug) FROM b_teams WHERE contains(lower(slug), '9') OR contains(lower(abbreviation), '9') ORDER BY id LIMIT 7)"
       " UNION ALL (SELECT 'games', id, round FROM b_games WHERE contains(cast(game_date AS string), '9') OR contains(lower(phase), '9') OR contains(round, '9') OR contains(boxscore_url, '9') ORDER BY game_date, id LIMIT 7)"
       " UNION ALL (SELECT 'seasons', id, name FROM b_seasons WHERE contains(name, '9') OR contains(slug, '9') OR contains(cast(start_year AS string), '9') OR contains(cast(end_year AS string), '9') ORDER BY start_year, id LIMIT 7)"))
def _(t):
    return q.global_search({"players": t.players, "teams": t.teams, "games": t.games, "seasons": t.seasons}, "9", 7)


@query("alias_lookup", sql(("b_nicknames", "b_players"),
       "SELECT player_id, alias AS matched_value, full_name, 'player_aliases' AS matched_via FROM b_nicknames n LEFT JOIN b_players p ON p.id = n.player_id WHERE contains(lower(alias), 'atleta 1') ORDER BY full_name NULLS FIRST, player_id LIMIT 25"))
def _(t):
    return q.alias_lookup(t.nicknames.select("player_id", "alias"), t.players, "ATLETA 1", 25)
