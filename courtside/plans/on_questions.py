"""Questions in batch: intent, the players they name, answers."""

from pyspark.sql import functions as F

from ..operators import ask
from .bindings import add_view, sql
from .on_functions import s_fold, s_metric
from .on_lists import NEWEST, UNIQUE
from .registry import query

_T = "coalesce(" + s_fold("question") + ", '')"
_G1, _G2 = ask.TOP_GAMES[0][0], ask.TOP_GAMES[1][0]


def s_x(text, pattern, group):
    return f"regexp_extract({text}, '{pattern}', {group})"


def s_number(text, high):
    return f"CASE WHEN regexp_matches({text}, '^\\d+$') THEN least(greatest(coalesce(try_cast({text} AS bigint), {high}), 1), {high}) END"


def s_strip(text):
    return f"regexp_replace({text}, '{ask.PUNCTUATION}', '', 'g')"


def _s_parse(source: str) -> str:
    hit1, hit2 = f"regexp_matches(t, '{_G1}')", f"regexp_matches(t, '{_G2}')"
    steps = (f"SELECT *, CASE WHEN {hit1} THEN {s_x('t', _G1, 1)} ELSE {s_x('t', _G2, 1)} END AS tn, CASE WHEN {hit1} THEN trim({s_x('t', _G1, 3)}) ELSE trim({s_x('t', _G2, 2)}) END AS tp,"
             f" CASE WHEN {hit1} THEN {s_x('t', _G1, 2)} ELSE {s_x('t', _G2, 3)} END AS tm, {hit1} OR {hit2} AS hit, regexp_matches(t, '{ask.TOP}') AS is_top, {s_x('t', ask.TOP, 2)} AS top_text,"
             f" trim(regexp_replace(regexp_replace(t, '{ask.RECENT}', '', 'g'), ' +', ' ', 'g')) AS plain FROM (SELECT *, {_T} AS t FROM {source})")
    def split(word, n):
        return s_strip(s_x("' ' || plain || ' '", f"^(.*?{ask.EDGE}){word}({ask.EDGE}.*)$", n))

    left = "CASE " + " ".join(f"WHEN {split(w, 1)} <> '' AND {split(w, 2)} <> '' THEN {split(w, 1)}" for w in ask.SEPARATORS) + " END"
    right = "CASE " + " ".join(f"WHEN {split(w, 1)} <> '' AND {split(w, 2)} <> '' THEN {split(w, 2)}" for w in ask.SEPARATORS) + " END"
    name = s_strip("plain")
    wrapped = f"SELECT *, {s_metric('tm')} AS tmetric, {s_metric('top_text')} AS top_metric, {left} AS side_l, {right} AS side_r, {name} AS n0 FROM ({steps})"
    for i, prefix in enumerate(ask.PREFIXES):
        wrapped = f"SELECT *, CASE WHEN starts_with(n{i}, '{prefix}') THEN trim(substr(n{i}, {len(prefix) + 1})) ELSE n{i} END AS n{i + 1} FROM ({wrapped})"
    last = f"n{len(ask.PREFIXES)}"
    target = "CASE WHEN contains(top_text, 'time') OR contains(top_text, 'equipes') THEN 'teams' ELSE 'players' END"
    history = " OR ".join(f"contains(top_text, '{w}')" for w in ask.HISTORY_WORDS)
    intent = (f"CASE WHEN hit AND tmetric IS NOT NULL AND tp <> '' THEN 'player_top_games' WHEN is_top AND top_metric IS NOT NULL AND {target} = 'teams' AND ({history}) THEN 'team_history_ranking'"
              f" WHEN is_top AND top_metric IS NOT NULL THEN 'ranking' WHEN is_top THEN 'unknown' WHEN side_l IS NOT NULL THEN 'players_head_to_head_recent_games' WHEN {last} <> '' THEN 'player_recent_games' ELSE 'unknown' END")
    ranked = "intent IN ('ranking', 'team_history_ranking')"
    return (f"SELECT question_id, question, intent, CASE intent WHEN 'player_top_games' THEN tp WHEN 'players_head_to_head_recent_games' THEN side_l WHEN 'player_recent_games' THEN {last} END AS player_1,"
            " CASE WHEN intent = 'players_head_to_head_recent_games' THEN side_r END AS player_2,"
            f" CASE WHEN intent IN ('players_head_to_head_recent_games', 'player_recent_games') THEN coalesce({s_number(s_x('t', ask.RECENT, 1), 50)}, 5) END AS last_n_games,"
            f" CASE WHEN {ranked} THEN {target} END AS ranking_target, CASE WHEN intent = 'player_top_games' THEN tmetric WHEN {ranked} THEN top_metric END AS metric,"
            f" CASE WHEN intent = 'player_top_games' THEN {s_number('tn', 50)} WHEN {ranked} THEN {s_number(s_x('t', ask.TOP, 1), 200)} END AS top_n FROM (SELECT *, {intent} AS intent FROM ({wrapped}))")


add_view("b_parsed", ("b_questions",), _s_parse("b_questions"))


@query("question_intent", sql("b_parsed", "SELECT * FROM b_parsed"))
def _(t):
    return ask.question_intent(t.questions)


add_view("b_turns", (), "SELECT conv_id * 1000 + turn AS question_id, text AS question FROM conversations")


@query("question_intent_of_conversations", sql("b_turns", f"SELECT * EXCLUDE (question) FROM ({_s_parse('b_turns')})"))
def _(t):
    turns = t.raw("conversations").selectExpr("conv_id * 1000 + turn AS question_id", "text AS question")
    return ask.question_intent(turns).drop("question")


# --- players named ---------------------------------------------------------------------------------

add_view("b_entries", ("b_players", "b_nicknames"),
         "SELECT 0 AS turn, id AS player_id, coalesce(full_name, '') AS sort_name, coalesce(full_name, display_name, slug) AS matched_value, [full_name, display_name, slug] AS texts, [full_name, display_name, slug] AS exact FROM b_players"
         " UNION ALL SELECT 1, player_id, coalesce(full_name, ''), alias, [alias], [full_name, display_name, slug, alias] FROM b_nicknames LEFT JOIN b_players p ON p.id = player_id")
add_view("b_asked", ("b_parsed",), "SELECT DISTINCT query FROM (SELECT unnest([player_1, player_2]) AS query FROM b_parsed) WHERE query IS NOT NULL")
add_view("b_found", ("b_asked", "b_entries"),
         "SELECT *, row_number() OVER (PARTITION BY query, turn ORDER BY sort_name, player_id, matched_value) AS place FROM b_asked, b_entries"
         " WHERE len(list_filter(texts, lambda x: contains(lower(x), query))) > 0")
add_view("b_candidates", ("b_found",),
         "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY turn, place) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query, player_id ORDER BY turn, place) AS copy FROM b_found WHERE place <= 10) WHERE copy = 1) WHERE rank <= 10")
add_view("b_hits", ("b_found",),
         "SELECT query, player_id, turn, bool_or(turn = 1 AND strip_accents(lower(matched_value)) = query) AS alias_equal, bool_or(list_contains(list_transform(exact, lambda x: strip_accents(lower(x))), query)) AS is_exact"
         " FROM b_found GROUP BY query, player_id, turn QUALIFY turn = min(turn) OVER (PARTITION BY query, player_id)")
add_view("b_tally", ("b_hits",),
         "SELECT query, count(*) AS n, count(*) FILTER (alias_equal) AS na, min(player_id) FILTER (alias_equal) AS pa,"
         " count(*) FILTER (is_exact) AS ne, min(player_id) FILTER (is_exact) AS pe, min(player_id) AS lone FROM b_hits GROUP BY query")
add_view("b_single", ("b_asked", "b_tally"),
         "SELECT query, CASE WHEN n IS NULL THEN 'not_found' WHEN pid IS NOT NULL THEN 'ok' ELSE 'ambiguous' END AS status, pid AS player_id, coalesce(n, 0) AS candidates FROM"
         " (SELECT a.query, t.n, CASE WHEN NOT contains(a.query, ' ') AND length(a.query) <= 6 AND n > 1 THEN NULL WHEN na = 1 THEN pa WHEN ne = 1 THEN pe WHEN n = 1 THEN lone END AS pid FROM b_asked a LEFT JOIN b_tally t USING (query))")
add_view("b_named", ("b_parsed", "b_single"),
         "SELECT p.*, x.status AS status_1, x.player_id AS player_id_1, y.status AS status_2, y.player_id AS player_id_2 FROM b_parsed p LEFT JOIN b_single x ON x.query = p.player_1 LEFT JOIN b_single y ON y.query = p.player_2")


def _asked(t):
    return t.parsed.select(F.explode(F.array("player_1", "player_2")).alias("query")).filter("query IS NOT NULL")


@query("candidate_union", sql("b_candidates", "SELECT query, rank AS candidate_rank, player_id, CASE turn WHEN 0 THEN 'players' ELSE 'player_aliases' END AS matched_via, matched_value FROM b_candidates"))
def _(t):
    found = ask.player_candidates(_asked(t), ask.name_entries(t.players, t.nicknames))
    return found.select("query", "candidate_rank", "player_id", "matched_via", "matched_value")


@query("resolve_single_player", sql("b_single", "SELECT * FROM b_single"))
def _(t):
    return ask.resolve_single_player(_asked(t), t.players, t.nicknames)


add_view("b_answer_status", ("b_named",),
         "SELECT question_id, intent, CASE WHEN intent = 'unknown' THEN 'unsupported' WHEN intent = 'players_head_to_head_recent_games' THEN CASE WHEN status_1 = 'ok' AND status_2 = 'ok' THEN 'ok' ELSE 'needs_clarification' END"
         " WHEN intent IN ('player_recent_games', 'player_top_games') THEN CASE status_1 WHEN 'ok' THEN 'ok' WHEN 'not_found' THEN 'not_found' ELSE 'needs_clarification' END ELSE 'ok' END AS status, player_id_1, player_id_2 FROM b_named")


@query("answer_status", sql("b_answer_status", "SELECT * FROM b_answer_status"))
def _(t):
    return ask.answer_status(t.named)


# --- answers ---------------------------------------------------------------------------------------------

LINE = ["question_id", "player_id", "game_id", "line_no", "part_id", "points"]


@query("answer_recent_games", sql(("b_named", "b_player_games"),
       f"SELECT question_id, player_id, game_id, line_no, part_id, points, game_date FROM b_named JOIN (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY {NEWEST}) AS rn FROM b_player_games) ON player_id = player_id_1"
       " WHERE intent = 'player_recent_games' AND status_1 = 'ok' AND rn <= last_n_games"))
def _(t):
    return ask.answer_recent_games(t.named, t.stats, t.games, UNIQUE).select(*LINE, "game_date")


@query("answer_top_games", sql(("b_named", "b_player_games"),
       "SELECT question_id, player_id, game_id, line_no, part_id, points, metric, ranking_value FROM b_named JOIN (SELECT *, row_number() OVER (PARTITION BY player_id, m ORDER BY ranking_value DESC, "
       f"{NEWEST}) AS rn FROM (SELECT *, 'points' AS m, cast(points AS double) AS ranking_value FROM b_player_games UNION ALL SELECT *, 'rebounds', cast(total_rebounds AS double) FROM b_player_games))"
       " ON player_id = player_id_1 AND m = metric WHERE intent = 'player_top_games' AND status_1 = 'ok' AND rn <= top_n"))
def _(t):
    return ask.answer_top_games(t.named, t.stats, t.games, UNIQUE).select(*LINE, "metric", "ranking_value")


@query("answer_head_to_head", sql(("b_named", "b_stats", "b_games"),
       "SELECT q.question_id, s.player_id, s.game_id, s.line_no, s.part_id, s.points FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY game_date DESC, game_id DESC) AS rn FROM"
       " (SELECT DISTINCT n.question_id, n.player_id_1, n.player_id_2, n.last_n_games, a.game_id, g.game_date FROM b_named n JOIN b_stats a ON a.player_id = n.player_id_1 JOIN b_stats b ON b.player_id = n.player_id_2 AND b.game_id = a.game_id AND b.team_id <> a.team_id"
       " JOIN b_games g ON g.id = a.game_id WHERE n.intent = 'players_head_to_head_recent_games' AND n.status_1 = 'ok' AND n.status_2 = 'ok')) q JOIN b_stats s ON s.game_id = q.game_id AND s.player_id IN (q.player_id_1, q.player_id_2) WHERE rn <= last_n_games"))
def _(t):
    return ask.answer_head_to_head(t.named, t.stats, t.games).select(*LINE)


@query("answer_ranking", sql(("b_parsed", "b_career", "b_ts"),
       "SELECT question_id, metric, ranking_target, place, player_id, NULL::bigint AS team_id, ranking_value FROM b_parsed JOIN (SELECT player_id, cast(assists_total AS double) AS ranking_value, cast(row_number() OVER (ORDER BY assists_total DESC, player_id) AS int) AS place FROM b_career) ON place <= top_n"
       " WHERE intent = 'ranking' AND ranking_target = 'players' AND metric = 'assists'"
       " UNION ALL SELECT question_id, metric, ranking_target, place, NULL, team_id, ranking_value FROM b_parsed JOIN (SELECT team_id, cast(blocks_total AS double) AS ranking_value, cast(row_number() OVER (ORDER BY blocks_total DESC, season_id, competition, team_id) AS int) AS place FROM b_ts) ON place <= top_n"
       " WHERE intent = 'ranking' AND ranking_target = 'teams' AND metric = 'blocks'"))
def _(t):
    return ask.answer_ranking(t.parsed, t.career, t.team_seasons).select("question_id", "metric", "ranking_target", "place", "player_id", "team_id", "ranking_value")


@query("answer_team_history", sql(("b_parsed", "b_ts", "b_teams"),
       "SELECT question_id, metric, place, team_id, seasons_count, ranking_value, canonical_name AS team_name FROM b_parsed JOIN (SELECT *, cast(row_number() OVER (ORDER BY ranking_value DESC, team_id) AS int) AS place FROM"
       " (SELECT team_id, count(*) AS seasons_count, cast(sum(wins) AS double) AS ranking_value FROM b_ts GROUP BY team_id)) ON place <= top_n LEFT JOIN b_teams t ON t.id = team_id WHERE intent = 'team_history_ranking' AND metric = 'wins'"))
def _(t):
    return ask.answer_team_history(t.parsed, t.team_seasons, t.teams).select("question_id", "metric", "place", "team_id", "seasons_count", "ranking_value", "team_name")
