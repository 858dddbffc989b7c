"""Names to teams and players; similar names."""

from pyspark.sql import functions as F

from ..operators import resolve, similar
from . import on_rollups  # noqa: F401  (defines shared views)
from .bindings import add_view, sql
from .on_functions import s_key, s_norm, s_slug
from .registry import query

REQUEST = "season_id, team_id, player_name_raw, jersey_number"
SAME = " AND ".join(f"{{a}}.{c} IS NOT DISTINCT FROM {{b}}.{c}" for c in resolve.REQUEST)

# --- teams: an alias means another team each season --------------------------------------------

TEAM_ALIASES = {
    "id": "home_team_id * 10000 + season_id",
    "team_id": "home_team_id",
    "season_id": "season_id",
    "alias": "'Équipe ' || cast((home_team_id + season_id) % 30 as string)",
}
TEAM_REQUESTS = {
    "id": "id",
    "season_id": "season_id",
    "team_name_raw": "case when id % 4 = 0 then ' EQUIPE  ' || cast(away_team_id as string) when id % 4 = 1 then 'Nation ' || cast(away_team_id as string)"
                     " when id % 4 = 2 then 'desconhecido' else 'ninguém' end",
    "team_abbr_raw": "case when id % 4 = 2 then 't' || cast(home_team_id as string) else null end",
}


def _cols(columns):
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


add_view("b_team_aliases", ("b_games",), f"SELECT DISTINCT {_cols(TEAM_ALIASES)} FROM b_games")
add_view("b_team_requests", ("b_games",), f"SELECT {_cols(TEAM_REQUESTS)} FROM b_games")
add_view("b_global_keys", ("b_teams",),
         f"SELECT key, max(team_id) AS team_id FROM (SELECT id AS team_id, unnest([{s_key('canonical_name')}, {s_key('abbreviation')}, {s_key('slug')}]) AS key FROM b_teams) WHERE key IS NOT NULL GROUP BY key")


def _team_aliases(t):
    return t.games.selectExpr(*[f"{e} AS {n}" for n, e in TEAM_ALIASES.items()]).distinct()


def _team_requests(t):
    return t.games.selectExpr(*[f"{e} AS {n}" for n, e in TEAM_REQUESTS.items()])


@query("resolve_team", sql(("b_team_requests", "b_team_aliases", "b_global_keys"),
       "SELECT r.id, r.season_id, r.team_name_raw, coalesce((SELECT max(a.team_id) FROM b_team_aliases a WHERE a.season_id = r.season_id AND " + s_key("a.alias") + " = " + s_key("r.team_name_raw") + "),"
       " (SELECT max(a.team_id) FROM b_team_aliases a WHERE a.season_id = r.season_id AND " + s_key("a.alias") + " = " + s_key("r.team_abbr_raw") + "),"
       " (SELECT g.team_id FROM b_global_keys g WHERE g.key = " + s_key("r.team_name_raw") + "), (SELECT g.team_id FROM b_global_keys g WHERE g.key = " + s_key("r.team_abbr_raw") + ")) AS team_id FROM b_team_requests r"))
def _(t):
    return resolve.resolve_team(_team_requests(t), t.teams, _team_aliases(t)).select("id", "season_id", "team_name_raw", "team_id")


# --- players ----------------------------------------------------------------------------------------


@query("name_records", sql("b_records", "SELECT * FROM b_records"))
def _(t):
    return t.records


add_view("b_requests", ("b_open_lines",), f"SELECT DISTINCT {REQUEST}, {s_key('player_name_raw')} AS key FROM b_open_lines")
add_view("b_hits", ("b_requests", "b_records"),
         "SELECT r.*, c.player_id, CASE WHEN c.season_id = r.season_id AND c.team_id IS NOT DISTINCT FROM r.team_id AND c.jersey_number IS NOT DISTINCT FROM r.jersey_number THEN 1"
         " WHEN c.season_id = r.season_id AND c.team_id IS NOT DISTINCT FROM r.team_id AND c.jersey_number IS NULL THEN 2"
         " WHEN c.season_id = r.season_id AND c.team_id IS NOT DISTINCT FROM r.team_id THEN 3"
         " WHEN c.season_id = r.season_id AND c.jersey_number IS NOT DISTINCT FROM r.jersey_number THEN 4 WHEN c.season_id = r.season_id THEN 5"
         " WHEN c.season_id IS NULL AND c.team_id IS NULL AND c.jersey_number IS NULL THEN 6 ELSE 7 END AS strategy"
         f" FROM b_requests r JOIN (SELECT *, {s_key('name')} AS key FROM b_records) c USING (key)")
add_view("b_decided", ("b_requests", "b_hits"),
         f"SELECT {REQUEST}, CASE WHEN key IS NULL THEN 'empty_player_name' WHEN strategy IS NULL THEN 'no_alias_match' WHEN strategy = 7 THEN 'no_safe_match'"
         " WHEN n = 1 THEN 'resolved' ELSE 'ambiguous_match' END AS reason, CASE WHEN strategy < 7 AND n = 1 THEN pid END AS player_id,"
         " cast(CASE WHEN strategy < 7 THEN strategy END AS bigint) AS strategy, coalesce(n, 0) AS candidates FROM"
         " (SELECT r.*, d.strategy, d.n, d.pid FROM b_requests r LEFT JOIN (SELECT season_id, team_id, player_name_raw, jersey_number, strategy, n, pid FROM"
         f" (SELECT {REQUEST}, strategy, count(DISTINCT player_id) AS n, min(player_id) AS pid, row_number() OVER (PARTITION BY {REQUEST} ORDER BY strategy) AS rn"
         f" FROM b_hits GROUP BY {REQUEST}, strategy) WHERE rn = 1) d ON {SAME.format(a='r', b='d')})")


@query("resolve_player", sql("b_decided", "SELECT * FROM b_decided"))
def _(t):
    return resolve.resolve_requests(t.open_lines, t.records)


@query("resolve_players", sql(("b_open_lines", "b_decided"),
       f"SELECT l.game_id, l.points, l.player_name_raw, d.player_id, d.reason, d.candidates FROM b_open_lines l JOIN b_decided d ON {SAME.format(a='l', b='d')}"))
def _(t):
    return resolve.resolve_players(t.open_lines, t.records).select("game_id", "points", "player_name_raw", "player_id", "reason", "candidates")


@query("resolution_candidates", sql(("b_decided", "b_hits"),
       f"SELECT DISTINCT d.season_id, d.team_id, d.player_name_raw, d.jersey_number, h.player_id FROM b_decided d JOIN b_hits h ON {SAME.format(a='d', b='h')}"
       " WHERE (d.reason = 'ambiguous_match' AND h.strategy = d.strategy) OR d.reason = 'no_safe_match'"))
def _(t):
    return resolve.resolution_candidates(resolve.resolve_requests(t.open_lines, t.records), t.records)


@query("unresolved_groups", sql("b_open_lines", f"SELECT {REQUEST}, count(*) AS unresolved_rows, min(game_id) AS sample_game_id FROM b_open_lines GROUP BY {REQUEST}"))
def _(t):
    return resolve.unresolved_groups(t.open_lines, ["game_id"])


# --- similar names -------------------------------------------------------------------------------------


def s_same(a, b):
    return f"replace({a}, ' ', '') = replace({b}, ' ', '')"


def s_words(c):
    return f"list_distinct(string_split({c}, ' '))"


def s_edit(a, b):
    return f"(1.0::double - levenshtein({a}, {b})::double / greatest(length({a}), length({b})))"


def s_overlap(a, b):
    return f"(len(list_intersect({s_words(a)}, {s_words(b)}))::double / greatest(len({s_words(a)}), len({s_words(b)})))"


def s_similar(a, b):
    return f"CASE WHEN {s_same(a, b)} THEN 1.0::double ELSE greatest({s_edit(a, b)}, {s_overlap(a, b)}) END"


def s_review(a, b):
    part = f"(list_contains({s_words(b)}, {a}) OR list_contains({s_words(a)}, {b}))"
    head = f"(starts_with({b}, {a} || ' ') OR starts_with({a}, {b} || ' '))"
    return f"greatest({s_similar(a, b)}, CASE WHEN {part} THEN 0.92::double WHEN {head} THEN 0.90::double ELSE 0.0::double END)"


add_view("b_groups", ("b_open_lines",), f"SELECT {REQUEST}, count(*) AS unresolved_rows, min(game_id) AS sample_game_id, {s_norm('player_name_raw')} AS a FROM b_open_lines GROUP BY {REQUEST}")
add_view("b_left", ("b_groups",), "SELECT DISTINCT a FROM b_groups WHERE a IS NOT NULL")
add_view("b_normed", ("b_records",), f"SELECT DISTINCT player_id, name AS candidate_name, season_id AS rs, team_id AS rt, jersey_number AS rj, source, {s_norm('name')} AS b FROM b_records")
add_view("b_right", ("b_normed",), "SELECT DISTINCT b FROM b_normed WHERE b IS NOT NULL")
# pairs that share a word or are equal but for spacing, and pairs by their edits alone: no word list is made for these
add_view("b_wordy", ("b_left", "b_right"),
         f"SELECT DISTINCT a, b FROM (SELECT a, unnest({s_words('a')}) AS word FROM b_left) JOIN (SELECT b, unnest({s_words('b')}) AS word FROM b_right) USING (word)"
         " UNION SELECT a, b FROM b_left JOIN b_right ON replace(a, ' ', '') = replace(b, ' ', '')")


def s_pairs(score, least):
    return (f"SELECT a, b, similarity FROM (SELECT a, b, {score} AS similarity FROM b_wordy) WHERE similarity >= {least}"
            f" UNION ALL SELECT a, b, similarity FROM (SELECT a, b, {s_edit('a', 'b')} AS similarity FROM b_left JOIN b_right"
            f" ON length(b) >= {least} * length(a) - 0.001 AND length(b) * {least} <= length(a) + 0.001) WHERE similarity >= {least} AND (a, b) NOT IN (SELECT (a, b) FROM b_wordy)")


add_view("b_pairs", ("b_wordy",), s_pairs(s_similar('a', 'b'), 0.72))
add_view("b_review_pairs", ("b_wordy",), s_pairs(s_review('a', 'b'), 0.65))


def _groups(t):
    return t.groups


@query("similar_names", sql("b_pairs", "SELECT * FROM b_pairs"))
def _(t):
    return similar._name_pairs(_groups(t), t.stored_records, 720, False)


@query("similar_names_for_review", sql("b_review_pairs", "SELECT * FROM b_review_pairs"))
def _(t):
    return similar._name_pairs(_groups(t), t.stored_records, 650, True)


TIE = "player_id, candidate_name, rs NULLS FIRST, rt NULLS FIRST, rj NULLS FIRST, source"
add_view("b_scored", ("b_groups", "b_pairs", "b_normed"),
         f"SELECT *, row_number() OVER (PARTITION BY {REQUEST} ORDER BY score DESC, {TIE}) AS rn FROM (SELECT g.*, p.similarity, n.player_id, n.candidate_name, n.rs, n.rt, n.rj, n.source,"
         " p.similarity * 100 + CASE WHEN n.rs = g.season_id THEN 25 ELSE 0 END + CASE WHEN n.rt = g.team_id THEN 30 WHEN n.rt IS NOT NULL AND g.team_id IS NOT NULL THEN -45 ELSE 0 END"
         " + CASE WHEN n.rj = g.jersey_number THEN 20 WHEN n.rj IS NOT NULL AND g.jersey_number IS NOT NULL THEN -20 ELSE 0 END AS score"
         " FROM b_groups g JOIN b_pairs p USING (a) JOIN b_normed n USING (b))")
_CONTEXT = "(f.rs IS NOT DISTINCT FROM g.season_id OR f.rt IS NOT DISTINCT FROM g.team_id OR f.rj IS NOT DISTINCT FROM g.jersey_number)"
_MARGIN = "(f.score - coalesce(s.score, 0))"
_VERY = f"(f.score >= 150 AND {_MARGIN} >= 6 AND {_CONTEXT})"
_HIGH = f"(f.score >= 130 AND {_MARGIN} >= 12 AND {_CONTEXT})"


@query("fuzzy_candidates", sql("b_scored",
       f"SELECT g.season_id, g.team_id, g.player_name_raw, g.jersey_number, g.unresolved_rows, g.sample_game_id, CASE WHEN {_VERY} OR {_HIGH} THEN 'auto' ELSE 'manual' END AS decision,"
       f" CASE WHEN f.player_id IS NULL THEN 'no_candidate' WHEN {_VERY} THEN 'very_high_confidence' WHEN {_HIGH} THEN 'high_confidence' ELSE 'needs_review' END AS reason,"
       " f.player_id AS suggested_player_id, f.candidate_name AS matched_alias, f.similarity, f.score, CASE WHEN f.player_id IS NOT NULL THEN coalesce(s.score, 0.0::double) END AS second_score, f.source"
       f" FROM b_groups g LEFT JOIN (SELECT * FROM b_scored WHERE rn = 1) f ON {SAME.format(a='g', b='f')} LEFT JOIN (SELECT * FROM b_scored WHERE rn = 2) s ON {SAME.format(a='g', b='s')}"))
def _(t):
    return similar.fuzzy_candidates(_groups(t), t.stored_records)


_REVIEW_POINTS = ("(CASE WHEN n.rs = g.season_id THEN 35 WHEN n.rs IS NOT NULL THEN -15 ELSE 0 END + CASE WHEN n.rt = g.team_id THEN 45 WHEN n.rt IS NOT NULL THEN -60 ELSE 0 END"
                  " + CASE WHEN n.rj = g.jersey_number THEN 30 WHEN n.rj IS NOT NULL THEN -25 ELSE 0 END)")
# a record that no field lifts needs a similar name; every other one is met by an equal field
_MEET = ("coalesce(n.rt = g.team_id, false)", "coalesce(n.rs = g.season_id, false)", "coalesce(n.rj = g.jersey_number, false)")
add_view("b_left_no", ("b_left",), "SELECT a, row_number() OVER (ORDER BY a) AS no FROM b_left")
add_view("b_right_no", ("b_right",), "SELECT b, row_number() OVER (ORDER BY b) AS no FROM b_right")
add_view("b_alike", ("b_wordy", "b_left_no", "b_right_no"),  # one number for a pair of names
         f"SELECT x.no << 32 | y.no AS pair, max(similarity) AS similarity FROM (SELECT a, b, {s_review('a', 'b')} AS similarity FROM b_wordy"
         f" UNION ALL SELECT a, b, {s_edit('a', 'b')} FROM b_left, b_right) JOIN b_left_no x USING (a) JOIN b_right_no y USING (b) GROUP BY pair")
add_view("b_met", ("b_groups", "b_normed", "b_left_no", "b_right_no"), " UNION ALL ".join(
    f"SELECT g.* EXCLUDE (no), n.player_id, n.candidate_name, n.rs, n.rt, n.rj, n.source, g.no << 32 | n.no AS pair, {_REVIEW_POINTS} AS points"
    f" FROM (SELECT * FROM b_groups LEFT JOIN b_left_no USING (a)) g JOIN (SELECT * FROM b_normed LEFT JOIN b_right_no USING (b)) n ON {on} WHERE {_REVIEW_POINTS} > 0"
    + "".join(f" AND NOT {earlier}" for earlier in _MEET[:i]) for i, on in enumerate(("n.rt = g.team_id", "n.rs = g.season_id", "n.rj = g.jersey_number"))))
add_view("b_review", ("b_groups", "b_review_pairs", "b_normed", "b_alike", "b_met"),
         f"SELECT *, row_number() OVER (PARTITION BY {REQUEST} ORDER BY score DESC, {TIE}) AS rn FROM ("
         f"SELECT g.*, n.player_id, n.candidate_name, n.rs, n.rt, n.rj, n.source, p.similarity, p.similarity * 100 + {_REVIEW_POINTS} AS score"
         f" FROM b_groups g JOIN b_review_pairs p USING (a) JOIN b_normed n USING (b) WHERE p.similarity * 100 + {_REVIEW_POINTS} >= 65"
         + "".join(f" UNION ALL SELECT m.* EXCLUDE (pair, points), p.similarity, p.similarity * 100 + points FROM (SELECT * FROM b_met WHERE points > {low} AND points <= {high}) m"
                   f" JOIN (SELECT * FROM b_alike WHERE similarity < 0.65 AND similarity * 100 >= 65 - {high}) p USING (pair) WHERE p.similarity * 100 + points >= 65"
                   for low, high in ((0, 5), (5, 15), (15, 35), (35, 64), (64, 110)))
         + " UNION ALL SELECT m.* EXCLUDE (pair, points), 0.0::double, points::double FROM b_met m WHERE pair IS NULL AND points >= 65) QUALIFY rn <= 8")


def _s_signal(r, q, word):
    return f"CASE WHEN {r} = {q} THEN 'same_{word}' WHEN {r} IS NOT NULL THEN 'wrong_{word}' END"


@query("top_candidates", sql(("b_groups", "b_review"),
       "SELECT g.season_id, g.team_id, g.player_name_raw, g.jersey_number, r.rn AS candidate_rank, r.player_id, r.candidate_name, r.similarity, r.score,"
       f" CASE WHEN r.rn IS NULL THEN 'no_candidate' ELSE concat_ws('|', {_s_signal('r.rs', 'g.season_id', 'season')}, {_s_signal('r.rt', 'g.team_id', 'team')},"
       f" {_s_signal('r.rj', 'g.jersey_number', 'jersey')}, CASE WHEN r.similarity >= 0.90 THEN 'strong_name' WHEN r.similarity >= 0.75 THEN 'medium_name' ELSE 'weak_name' END) END AS signals, r.source"
       f" FROM b_groups g LEFT JOIN b_review r ON {SAME.format(a='g', b='r')}"))
def _(t):
    return similar.top_candidates(_groups(t), t.stored_records)


# --- one player per jersey ----------------------------------------------------------------------------------

add_view("b_worn", ("b_records",), "SELECT * FROM b_records WHERE season_id IS NOT NULL AND team_id IS NOT NULL AND jersey_number IS NOT NULL")
add_view("b_seat", ("b_worn",), "SELECT season_id, team_id, jersey_number, count(DISTINCT player_id) AS candidates, min(player_id) AS player_id FROM b_worn GROUP BY 1, 2, 3")
add_view("b_seat_names", ("b_seat", "b_worn", "b_pool_players"),
         f"SELECT DISTINCT season_id, team_id, jersey_number, known, {s_norm('known')} AS kn FROM (SELECT s.season_id, s.team_id, s.jersey_number, w.name AS known FROM b_seat s JOIN b_worn w USING (season_id, team_id, jersey_number) WHERE candidates = 1"
         " UNION ALL SELECT s.season_id, s.team_id, s.jersey_number, unnest([p.full_name, p.display_name]) FROM b_seat s JOIN b_pool_players p ON p.id = s.player_id WHERE candidates = 1) WHERE known IS NOT NULL")
_INSIDE = f"list_has_all({s_words('kn')}, {s_words('a')})"
_FIT = (f"CASE WHEN a IS NULL THEN 0.0::double WHEN {s_same('a', 'kn')} THEN 1.0::double WHEN {_INSIDE} THEN greatest({s_edit('a', 'kn')}, 0.93::double)"
        f" WHEN starts_with(kn, a || ' ') THEN greatest({s_edit('a', 'kn')}, 0.90::double) ELSE {s_edit('a', 'kn')} END")
add_view("b_fit", ("b_groups", "b_seat_names"),
         f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {REQUEST} ORDER BY fit DESC, known) AS rn FROM (SELECT g.season_id, g.team_id, g.player_name_raw, g.jersey_number, n.known, {_FIT} AS fit"
         " FROM b_groups g JOIN b_seat_names n USING (season_id, team_id, jersey_number))) WHERE rn = 1")


@query("unique_jersey", sql(("b_groups", "b_seat", "b_fit"),
       "SELECT g.season_id, g.team_id, g.player_name_raw, g.jersey_number, g.unresolved_rows, g.sample_game_id, CASE WHEN s.candidates = 1 AND f.fit >= 0.88 THEN 'auto' ELSE 'manual' END AS decision,"
       " CASE WHEN s.candidates IS NULL THEN 'no_candidate_for_jersey' WHEN s.candidates > 1 THEN 'jersey_not_unique' WHEN f.fit >= 0.88 THEN 'unique_jersey_name_match' ELSE 'unique_jersey_but_name_mismatch' END AS reason,"
       " coalesce(s.candidates, 0) AS candidates, CASE WHEN s.candidates = 1 THEN s.player_id END AS resolved_player_id, f.fit AS name_score, f.known AS matched_name"
       f" FROM b_groups g LEFT JOIN b_seat s USING (season_id, team_id, jersey_number) LEFT JOIN b_fit f ON {SAME.format(a='g', b='f')}"))
def _(t):
    return similar.unique_jersey(_groups(t), t.stored_records, t.pool_players)
