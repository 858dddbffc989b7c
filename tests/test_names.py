import random

import pytest
from pyspark.sql import functions as F

from courtside.operators import ask, merge, resolve, similar

RECORD = "player_id bigint, name string, season_id bigint, team_id bigint, jersey_number string, source string"
LINE = "season_id bigint, team_id bigint, player_name_raw string, jersey_number string"


def test_player_strategies(spark):
    records = spark.createDataFrame([
        (1, "João Silva", 5, 1, "7", "a"), (2, "Joao Silva", 5, 1, "8", "a"), (3, "Lucas", 5, 2, None, "a"), (4, "Lucas", 5, 2, "9", "a"),
        (5, "Pedro", 4, 1, "3", "a"), (6, "Caio", None, None, None, "players.full_name"),
    ], RECORD)
    lines = spark.createDataFrame([
        (5, 1, "JOÃO  SILVA", "7"), (5, 1, "Joao Silva", None), (5, 2, "Lucas", "1"), (5, 1, "Pedro", "3"), (5, 1, "Caio", "0"), (5, 1, " ", "1"), (5, 1, "Rui", "1"), (5, None, "Lucas", "9"),
    ], LINE)
    resolved = resolve.resolve_requests(lines, records)
    got = {(r.player_name_raw, r.jersey_number): (r.player_id, r.reason, r.strategy) for r in resolved.collect()}
    assert got["JOÃO  SILVA", "7"] == (1, "resolved", 1)
    assert got["Joao Silva", None] == (None, "ambiguous_match", 3)
    assert got["Lucas", "1"] == (3, "resolved", 2)
    assert got["Pedro", "3"] == (None, "no_safe_match", None)
    assert got["Caio", "0"] == (6, "resolved", 6)
    assert got[" ", "1"][1] == "empty_player_name" and got["Rui", "1"][1] == "no_alias_match"
    assert got["Lucas", "9"] == (4, "resolved", 4)
    names = {(r.player_name_raw, r.player_id) for r in resolve.resolution_candidates(resolved, records).collect()}
    assert names == {("Joao Silva", 1), ("Joao Silva", 2), ("Pedro", 5)}


def test_team_by_season_alias_then_anywhere(spark):
    teams = spark.createDataFrame([(1, "São Paulo", "SPO", "sao-paulo"), (2, "Franca", "FRA", "franca")], "id bigint, canonical_name string, abbreviation string, slug string")
    aliases = spark.createDataFrame([(1, 2, 5, "Sao Paulo"), (2, 1, 5, "SP")], "id bigint, team_id bigint, season_id bigint, alias string")
    asked = spark.createDataFrame([(5, "SÃO PAULO", None), (6, "São Paulo", None), (6, "x", "fra"), (6, "x", None), (5, "x", "S.P.")], "season_id bigint, team_name_raw string, team_abbr_raw string")
    got = {(r.season_id, r.team_name_raw, r.team_abbr_raw): r.team_id for r in resolve.resolve_team(asked, teams, aliases).collect()}
    assert got == {(5, "SÃO PAULO", None): 2, (6, "São Paulo", None): 1, (6, "x", "fra"): 2, (6, "x", None): None, (5, "x", "S.P."): 1}


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _similarity(a, b):
    if a.replace(" ", "") == b.replace(" ", ""):
        return 1.0
    wa, wb = set(a.split()), set(b.split())
    return max(1 - _levenshtein(a, b) / max(len(a), len(b)), len(wa & wb) / max(len(wa), len(wb)))


@pytest.mark.parametrize("per_mille", [720, 650, 900])
def test_similarity_join_finds_what_brute_force_finds(spark, per_mille):
    rng = random.Random(per_mille)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(12)]
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(160)} | {"joao silva", "joaosilva", "a", "ab"})
    left, right = names[::2], names[1::2] + names[:10]
    got = similar.similar_names(spark.createDataFrame([(n,) for n in left], "a string"), spark.createDataFrame([(n,) for n in right], "b string"), per_mille)
    expected = {(a, b) for a in left for b in set(right) if _similarity(a, b) * 1000 >= per_mille - 1e-9}
    assert {(r.a, r.b) for r in got.collect()} == expected


def _best(groups, records, weights, neutral, k):
    """Brute force of the context score: the k best (score, player) per group."""
    out = {}
    for g in groups:
        scored = []
        for r in records:
            s = _similarity(g[2], r[1])
            if s < 0.72:
                continue
            score = s * 100
            for field, q, v in (("season_id", g[0], r[2]), ("team_id", g[1], r[3]), ("jersey_number", g[3], r[4])):
                match, mismatch = weights[field]
                if v is not None and v == q:
                    score += match
                elif v is not None and (q is not None or not neutral):
                    score += mismatch
            scored.append((-round(score, 6), r[0]))
        out[g] = sorted(scored)[:k]
    return out


@pytest.mark.parametrize("neutral", [True, False])
def test_context_lookup_keeps_the_best(spark, neutral):
    rng = random.Random(3)
    names = ["ana lima", "ana lim", "ana limas", "rui costa"]
    pick = lambda values: rng.choice(values)
    records = [(i, pick(names), pick([1, 2, None]), pick([1, 2, 3, None]), pick(["1", "2", "3", None]), "a") for i in range(120)]
    groups = list({(pick([1, 2]), pick([1, 2, None]), pick(names), pick(["1", "2", None])) for _ in range(40)})
    weights = similar.SUGGEST_WEIGHTS if neutral else similar.REVIEW_WEIGHTS
    g, r = spark.createDataFrame(groups, LINE), spark.createDataFrame(records, RECORD)
    pairs = similar._name_pairs(g, r, 720, False)
    got = {}
    for row in similar.best_candidates(g, r, pairs, weights, 3, neutral).collect():
        key = (row.q_season_id, row.q_team_id, row.q_player_name_raw, row.q_jersey_number)
        got.setdefault(key, []).append((-round(row.score, 6), row.player_id))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in _best(groups, records, weights, neutral, 3).items() if v}


def test_review_candidates_by_name_and_context(spark):
    """Every record scored against every group; names that differ count where the context makes up for them."""
    rng = random.Random(5)
    names = ["ana lima", "ana limas", "rui costa", "bia", "rui", "jo xavier nunes"]
    pick = lambda values: rng.choice(values)
    records = [(i, pick(names), pick([1, 2, 3, None]), pick([1, 2, 3, 4, None]), pick(["1", "2", "3", None]), "a") for i in range(60)]
    groups = list({(pick([1, 2, 9]), pick([1, 2, 9, None]), pick([*names, "  ", "ze"]), pick(["1", "2", "9", None])) for _ in range(60)})
    groups += [(8, 8, "qqqq", "8")]
    g, r = spark.createDataFrame(groups, LINE), spark.createDataFrame(records, RECORD)
    alike = {(x.a, x.b): x.s for x in spark.createDataFrame([(a, b) for a in [*names, "ze", "qqqq"] for b in names], "a string, b string")
             .select("a", "b", similar.review_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    want = []
    for group in groups:
        season, team, raw, jersey = group
        scored = []
        for player, name, *context, source in records:
            score = alike.get((raw, name), 0.0) * 100
            for value, asked, (match, wrong) in zip(context, (season, team, jersey), similar.REVIEW_WEIGHTS.values()):
                score += 0 if value is None else match if value == asked else wrong
            if score >= 65:
                scored.append((-score, player))
        want += [(group, rank, player, round(-s, 6)) for rank, (s, player) in enumerate(sorted(scored)[:8], 1)] or [(group, None, None, None)]
    rows = similar.top_candidates(g, r).collect()
    got = [((x.season_id, x.team_id, x.player_name_raw, x.jersey_number), x.candidate_rank, x.player_id, x.score and round(x.score, 6)) for x in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any("weak_name" in x.signals for x in rows) and {x.signals for x in rows if x.candidate_rank is None} == {"no_candidate"}


def test_unique_jersey(spark):
    records = spark.createDataFrame([(1, "Andre Luiz Goes", 5, 1, "7", "a"), (2, "Bia", 5, 1, "8", "a"), (3, "Caio", 5, 1, "8", "a")], RECORD)
    players = spark.createDataFrame([(1, "Andre Luiz Goes")], "id bigint, full_name string")
    groups = spark.createDataFrame([(5, 1, "André", "7"), (5, 1, "Roberto", "7"), (5, 1, "Bia", "8"), (5, 1, "Bia", "9")], LINE)
    got = {(r.player_name_raw, r.jersey_number): (r.decision, r.reason) for r in similar.unique_jersey(groups, records, players).collect()}
    assert got == {("André", "7"): ("auto", "unique_jersey_name_match"), ("Roberto", "7"): ("manual", "unique_jersey_but_name_mismatch"),
                   ("Bia", "8"): ("manual", "jersey_not_unique"), ("Bia", "9"): ("manual", "no_candidate_for_jersey")}


# --- merges ----------------------------------------------------------------------------------


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "Ala", 1), (2, "b", "Pivô", 1)], "id bigint, slug string, position string, last_seen_season_id int")
    new = spark.createDataFrame([("a", " ", 2), ("b", "Pivô", 1), ("c", "Ala", 3), ("c", None, 4)], "slug string, position string, last_seen_season_id int")
    merged = merge.merge_players(old, new)
    rows = {r.slug: (r.id, r.position, r.last_seen_season_id, r.change) for r in merged.collect()}
    assert rows == {"a": (1, "Ala", 2, "updated"), "b": (2, "Pivô", 1, "unchanged"), "c": (None, "Ala", 4, "inserted")}
    assert {r.slug: r.id for r in merge.assign_ids(merged, ["slug"]).collect()} == {"a": 1, "b": 2, "c": 3}


def test_game_key_falls_back(spark):
    schema = "id bigint, source_game_id string, season_id int, game_date string, game_time string, home_team_id int, away_team_id int, home_team_name_raw string, away_team_name_raw string, home_score int, game_number string"
    old = spark.createDataFrame([(1, "G1", 1, "2020-01-01", "20:00", 1, 2, "A", "B", 70, "1"), (2, None, 1, "2020-01-02", "20:00", 1, 2, "A", "B", 70, "2")], schema)
    new = spark.createDataFrame([(None, "G1", 1, "2020-01-05", "20:00", 1, 2, "A", "B", 71, "1"), (None, " ", 1, "2020-01-02", "20:00", 1, 2, "A", "B", 72, "2"), (None, None, 1, "2020-01-02", "21:00", 1, 2, "A", "B", 73, "3")], schema)
    got = {(r.id, r.home_score, r.change) for r in merge.merge_games(old, new, ["season_id", "game_date", "game_time", "game_number"]).collect()}
    assert got == {(1, 71, "updated"), (2, 72, "updated"), (None, 73, "inserted")}


def test_rows_without_key_stay_apart(spark):
    schema = "slug string, position string, last_seen_season_id int"
    old = spark.createDataFrame([(1, None, "Ala", 1), (2, " ", "Pivô", 1), (3, "a", "Ala", 1)], "id bigint, " + schema)
    new = spark.createDataFrame([(None, "Armador", 2), ("", "Ala", 3), (None, "Armador", 2), ("a", "Pivô", 2)], schema)
    got = sorted(merge.merge_players(old, new).select("id", "position", "change").collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(1, "Ala", "unchanged"), (2, "Pivô", "unchanged"), (3, "Pivô", "updated"),
                                                       (None, "Armador", "inserted"), (None, "Ala", "inserted")], key=str)


def test_absent_columns_keep_their_values(spark):
    old = spark.createDataFrame([(1, 10, 1, 50, "seen twice"), (2, 11, 1, 60, None)], "id bigint, game_id int, team_id int, points int, note string")
    new = spark.createDataFrame([(10, 1, 50), (11, 1, 61), (12, 1, 70)], "game_id int, team_id int, points int")
    got = {tuple(r) for r in merge.merge_team_stats(old, new).select("id", "points", "note", "change").collect()}
    assert got == {(1, 50, "seen twice", "unchanged"), (2, 61, None, "updated"), (None, 70, None, "inserted")}


def test_the_row_read_last_wins(spark):
    schema = "source_game_id string, season_id int, game_date string, game_time string, home_team_id int, away_team_id int, home_team_name_raw string, away_team_name_raw string, home_score int"
    old = spark.createDataFrame([], "id bigint, " + schema)
    new = spark.createDataFrame([("G", 1, "2020-03-10", "20:00", 1, 2, "A", "B", None, 1), ("G", 1, "2020-03-02", "20:00", 1, 2, "A", "B", 80, 2)], schema + ", place int")
    assert [(r.game_date, r.home_score) for r in merge.merge_games(old, new, ["place"]).collect()] == [("2020-03-02", 80)]


def test_two_approvals_stop(spark):
    s = spark.createDataFrame([(1, 1, "x", "1", "manual", "1", 5), (1, 1, "x", "1", "manual", "1", 6)], LINE + ", decision string, approved string, suggested_player_id bigint")
    with pytest.raises(ValueError):
        merge.select_suggestions(s)
    assert merge.select_suggestions(s.limit(1)).count() == 1


def test_dnp_needs_no_minutes_and_no_statistics(spark):
    from courtside.constants import STAT_INPUTS

    rows = spark.createDataFrame([(1, 0.0, 0), (2, 0.0, 1), (3, 2.0, 0)], "id int, minutes_decimal double, fouls_committed int")
    lines = rows.withColumns({s: F.lit("") for s in STAT_INPUTS if s != "fouls_committed"})
    kept, removed = merge.remove_dnp(lines)
    assert {r.id for r in kept.collect()} == {2, 3} and {r.id for r in removed.collect()} == {1}


# --- questions ---------------------------------------------------------------------------------


def test_intents(spark):
    asked = [
        "top 3 jogos com mais pontos do Matheusinho", "Top 99 partidas da Ana com mais Rebotes", "top 10 times com mais vitórias na história", "top 300 pontos", "top 5 xyz",
        "Ana VS Bia últimos 8 jogos", "vsevolod ultimos 80 jogos", "estatísticas de João", "", "top 0 assistências",
    ]
    df = spark.createDataFrame(list(enumerate(asked)), "question_id int, question string")
    got = [tuple(r)[2:] for r in ask.question_intent(df).orderBy("question_id").collect()]
    assert got == [
        ("player_top_games", "matheusinho", None, None, None, "points", 3), ("player_top_games", "ana", None, None, None, "rebounds", 50),
        ("team_history_ranking", None, None, None, "teams", "wins", 10), ("ranking", None, None, None, "players", "points", 200), ("unknown",) + (None,) * 6,
        ("players_head_to_head_recent_games", "ana", "bia", 8, None, None, None), ("player_recent_games", "vsevolod", None, 50, None, None, None),
        ("player_recent_games", "joao", None, 5, None, None, None), ("unknown",) + (None,) * 6, ("ranking", None, None, None, "players", "assists", 1),
    ]


def test_named_players(spark):
    players = spark.createDataFrame([(1, "Lucas Dias", "lucas-dias"), (2, "Lucas Lima", "lucas-lima"), (3, "Bennett", "bennett")], "id bigint, full_name string, slug string")
    aliases = spark.createDataFrame([(1, "Luquinha"), (2, "Lima")], "player_id bigint, alias string")
    names = ["lucas", "lucas dias", "luquinha", "ben", "ninguem", "lima", "as d"]
    got = {r.query: (r.status, r.player_id) for r in ask.resolve_single_player(spark.createDataFrame([(n,) for n in names], "query string"), players, aliases).collect()}
    assert got == {"lucas": ("ambiguous", None), "lucas dias": ("ok", 1), "luquinha": ("ok", 1), "ben": ("ok", 3), "ninguem": ("not_found", None),
                   "lima": ("ok", 2), "as d": ("ok", 1)}


def test_the_exact_player_stands_far_down_the_list(spark):
    players = spark.createDataFrame([(i, f"A{i:02d} Santos Lima", f"a{i:02d}-santos-lima") for i in range(30)] + [(99, "Santos Lima", "santos-lima")],
                                    "id bigint, full_name string, slug string")
    aliases = spark.createDataFrame([(1, "Ala")], "player_id bigint, alias string")
    asked = spark.createDataFrame([("santos lima",), ("santos",)], "query string")
    got = {r.query: (r.status, r.player_id, r.candidates) for r in ask.resolve_single_player(asked, players, aliases).collect()}
    assert got == {"santos lima": ("ok", 99, 31), "santos": ("ambiguous", None, 31)}


def test_head_to_head_edge_cases(spark):
    """Same team, unknown team, both teams in one game, a player against themself, repeated lines."""
    lines = [
        (1, 10, 7, 5), (2, 10, 8, 6), (2, 10, 8, 6),       # met; a line twice
        (1, 11, 7, 5), (2, 11, 7, 6),                      # one team
        (1, 12, None, 5), (2, 12, 7, 6),                   # a team is unknown
        (1, 13, 7, 5), (1, 13, 8, 1), (2, 13, 7, 6),       # a line on either side
        (1, 14, 7, 5),                                     # alone
        (3, 20, 7, 5), (3, 21, 7, 5), (3, 21, 8, 4),       # against themself
    ]
    stats = spark.createDataFrame(lines, "player_id bigint, game_id bigint, team_id bigint, points bigint")
    games = spark.createDataFrame([(g, f"2024-01-{g}") for g in (10, 11, 12, 13, 20, 21)], "id bigint, game_date string")
    intent = "players_head_to_head_recent_games"
    named = spark.createDataFrame(
        [(1, intent, "ok", "ok", 1, 2, 2), (2, intent, "ok", "ok", 2, 1, 9), (3, intent, "ok", "ok", 3, 3, 9), (4, intent, "ok", "ambiguous", 1, None, 9)],
        "question_id bigint, intent string, status_1 string, status_2 string, player_id_1 bigint, player_id_2 bigint, last_n_games bigint")
    got = [(r.question_id, r.game_id, r.player_id, r.team_id) for r in ask.answer_head_to_head(named, stats, games).collect()]

    def met(a, b, g):
        return any(x[1] == y[1] == g and (x[2] is None or y[2] is None or x[2] != y[2])
                   for x in lines if x[0] == a for y in lines if y[0] == b)

    expected = []
    for q, a, b, n in ((1, 1, 2, 2), (2, 2, 1, 9), (3, 3, 3, 9)):
        for g in sorted((g for g in {x[1] for x in lines} if met(a, b, g)), reverse=True)[:n]:
            expected += [(q, g, p, t) for p, game, t, _ in lines if game == g and p in (a, b)]
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order(expected)


def test_answers_expand_only_what_is_asked(spark):
    stats = spark.createDataFrame(
        [(1, 10, 7, 5, 3), (1, 11, 9, None, 2), (1, 12, 4, 5, 1), (2, 10, 99, 99, 99)],
        "player_id bigint, game_id bigint, points bigint, assists bigint, line_no bigint")
    games = spark.createDataFrame([(10, "2024-01-10"), (11, "2024-01-11"), (12, "2024-01-12")], "id bigint, game_date string")
    named = spark.createDataFrame(
        [(1, "player_top_games", "ok", 1, "assists", 5), (2, "player_top_games", "ok", 1, "points", 2), (3, "player_top_games", "ok", 1, "wins", 2),
         (4, "player_top_games", "not_found", None, "points", 2)],
        "question_id bigint, intent string, status_1 string, player_id_1 bigint, metric string, top_n bigint")
    got = ask.answer_top_games(named, stats, games, ("line_no",))
    assert sorted((r.question_id, r.game_position, r.game_id, r.ranking_value) for r in got.collect()) == [
        (1, 1, 12, 5.0), (1, 2, 10, 5.0), (2, 1, 11, 9.0), (2, 2, 10, 7.0)]

    career = spark.createDataFrame([(1, 30, 4), (2, 20, None), (3, 30, 6)], "player_id bigint, points_total bigint, assists_total bigint")
    seasons = spark.createDataFrame([(7, 1, "c", 3)], "team_id bigint, season_id bigint, competition string, wins bigint")
    parsed = spark.createDataFrame(
        [(1, "ranking", "players", "points", 2), (2, "ranking", "players", "wins", 2), (3, "ranking", "teams", "wins", 9), (4, "unknown", None, None, None)],
        "question_id bigint, intent string, ranking_target string, metric string, top_n bigint")
    rows = ask.answer_ranking(parsed, career, seasons)
    assert sorted((r.question_id, r.place, r.player_id, r.team_id) for r in rows.collect()) == [(1, 1, 1, None), (1, 2, 3, None), (3, 1, None, 7)]
    assert ask.answer_ranking(parsed.filter("question_id = 4"), career, seasons).isEmpty()
