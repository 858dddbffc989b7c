"""Plans that must hold at any size: nothing expanded is collected on the driver for a broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from courtside import constants, session
from courtside.functions import text
from courtside.operators import edits, extract, merge, positions, quality, resolve, rollups, similar
from courtside.plans import bindings, on_pages


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def league(spark):
    records = spark.createDataFrame(
        [(1, "joao silva", 2020, 1, "4", "pool"), (2, "joao silvas", None, None, None, "pool"), (3, "pedro souza", 2020, None, "5", "pool")],
        "player_id long, name string, season_id long, team_id long, jersey_number string, source string")
    groups = spark.createDataFrame([(2020, 1, "João Silva", "4", 2, 9), (2020, 1, "Pedro  Sousa", None, 1, 8)],
                                   "season_id long, team_id long, player_name_raw string, jersey_number string, unresolved_rows long, sample_game_id long")
    return groups, records


@pytest.mark.parametrize("contained", [False, True])
def test_similar_names_broadcast_nothing(league, contained):
    pairs = similar._name_pairs(*league, 650, contained)
    assert "Broadcast" not in _plan(pairs)
    assert {(r.a, r.b) for r in pairs.collect()} >= {("joao silva", "joao silva"), ("joao silva", "joao silvas"), ("pedro sousa", "pedro souza")}


def test_fuzzy_candidates_broadcast_no_lookup(league):
    groups, records = league
    pairs = similar._name_pairs(groups, records, 720, False)
    best = similar.best_candidates(groups, records, pairs, similar.SUGGEST_WEIGHTS, 2, True)
    assert "Broadcast" not in _plan(best)
    assert {r.q_player_name_raw: r.player_id for r in best.filter("candidate_rank = 1").collect()} == {"João Silva": 1, "Pedro  Sousa": 3}


def test_team_details_are_not_broadcast(spark):
    page = "<table><tr><td><span class='team_first'>T1</span></td></tr><tr><td><a href='/equipes/um/'>Um</a></td></tr></table>"
    rows = extract.page_rows(spark.createDataFrame([(1, page)], "page_id long, html string")).localCheckpoint()
    teams = extract.extract_teams(rows, "https://example.org")
    assert "Broadcast" not in _plan(teams)
    assert [(r.abbreviation, r.team_slug) for r in teams.collect()] == [("T1", "um")]


def _edits(a: str, b: str) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


@pytest.mark.parametrize("per_mille", [501, 650, 720, 1000])
def test_names_compared_by_words_are_all_near_names(spark, per_mille, monkeypatch):
    """Every pair within the allowed edits is found, over several cells, and names of any length and letters."""
    monkeypatch.setattr(edits, "LEAST_NAMES", 30)
    rng = random.Random(per_mille)
    word = lambda n: "".join(rng.choice("abcdé 1") for _ in range(n))
    left = sorted({word(rng.choice([1, 2, 3, 5, 9, 14, 70])) for _ in range(150)})
    right = {word(rng.choice([1, 2, 4, 8, 13])) for _ in range(40)}
    for name in rng.sample(left, 70):
        at, to = rng.randrange(len(name)), rng.randrange(len(name))
        right |= {name, name[:at] + name[at + 1:], name[:at] + "x" + name[at:], name[:to] + "y" + name[to + 1:at] + name[at:]} - {""}
    # a name of the other side's letters only, and one long enough for several words of bits
    right |= {"zzzz", "ab " * 30}
    pairs = edits.edit_pairs(spark.createDataFrame([(n,) for n in left], "a string").localCheckpoint(),
                             spark.createDataFrame([(n,) for n in sorted(right)], "b string").localCheckpoint(), per_mille)
    near = {(a, b) for a in left for b in right if _edits(a, b) <= max(len(a), len(b)) * (1000 - per_mille) // 1000}
    found = [tuple(r) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == near and len(near) > 40
    # the two lists are dealt into cells, no piece of a name is exploded
    assert "MapInArrow" in _plan(pairs) and "Join" not in _plan(pairs)


def test_no_near_names(spark):
    names = lambda c, *n: spark.createDataFrame([(x,) for x in n], f"{c} string").localCheckpoint()
    assert edits.edit_pairs(names("a"), names("b", "ana"), 720).isEmpty() and edits.edit_pairs(names("a", "ana"), names("b"), 720).isEmpty()
    assert edits.edit_pairs(names("a", "ana", ""), names("b", "um nome bem comprido", ""), 720).isEmpty()


def _both(page: str):
    plain, standard = extract._PageParser(), extract._PageParser()
    standard.feed(page)
    standard.close()
    return plain.found if plain.read_plain(page) else None, standard.found


def test_plain_markup_reads_as_the_standard_parser_does():
    page = ("<!doctype html><!-- x --><title>a</title><h1>Um &amp; dois</h1><img src='/a.png' alt=q><script>if (a < b) '<td>'</script>"
            "<table class=\"x y\" idx=general><thead><tr><th>N</th></tr></thead><tbody><tr><td>1</td><td> 2&nbsp;3 </td><td class='c' hidden><b>4</b>5</td>"
            "<TD DATA-LABEL=L>6</TD><td><table><tr><td>in</td></tr></table>out</td><tr><td>7<td>8</tr></tbody></table>fim")
    plain, standard = _both(page)
    assert plain == standard and len(plain) >= 5


@pytest.mark.parametrize("page", ["<table><tr><td>1 < 2</td></tr></table>", "<table><tr><td><a href='?a&copy=1'>x</a></td></tr></table>",
                                  "<table><tr><td x='<'>1</td></tr></table>", "<table><tr><td>1</td></tr></table><!--", "<title><b></title>"])
def test_other_markup_is_left_to_the_standard_parser(page):
    plain, standard = _both(page)
    assert plain is None and extract._page_records(page) == standard


def test_requests_move_once_and_long_names_are_whole(spark):
    """A name with more lookup rows than stand beside it is decided as any other."""
    records = spark.createDataFrame([(i, "Ana", 2000 + i, 1, str(i), "a") for i in range(100)] + [(500, "Rui", 2000, 1, None, "a"), (501, "Rui", 2000, 2, "7", "a")],
                                    "player_id long, name string, season_id long, team_id long, jersey_number string, source string")
    lines = spark.createDataFrame([(2099, 1, "ANA", "99"), (2050, 9, "Ana", "50"), (2050, 9, "ana", "51"), (1990, 1, "Ana", "1"), (2000, 1, "Rui", "3"), (2000, None, "Rui", None),
                                   (2000, 1, "Eva", "3"), (2000, 1, " ", "3")], "season_id long, team_id long, player_name_raw string, jersey_number string")
    resolved = resolve.resolve_requests(lines, records)
    got = {(r.player_name_raw, r.jersey_number): (r.reason, r.player_id, r.strategy, r.candidates) for r in resolved.collect()}
    assert got == {
        ("ANA", "99"): ("resolved", 99, 1, 1), ("Ana", "50"): ("resolved", 50, 4, 1), ("ana", "51"): ("resolved", 50, 5, 1), ("Ana", "1"): ("no_safe_match", None, None, 100),
        ("Rui", "3"): ("resolved", 500, 2, 1), ("Rui", None): ("resolved", 500, 4, 1), ("Eva", "3"): ("no_alias_match", None, None, 0), (" ", "3"): ("empty_player_name", None, None, 0)}
    # only a request whose name is long becomes a row per strategy
    assert "array_min" in _plan(resolved)


def test_lines_are_dealt_by_their_number(spark, tmp_path):
    """A task of the join of lines and games holds a bounded number of lines, however well they compress."""
    folder = str(tmp_path)
    spark.range(1000).selectExpr("id AS l_orderkey", "id % 7 AS l_partkey", "id % 5 AS l_suppkey", "cast(id % 3 + 1 AS int) AS l_linenumber", "cast(id % 50 AS double) AS l_quantity").write.parquet(f"{folder}/lineitem.parquet")
    spark.range(1000).selectExpr("id AS o_orderkey", "id % 40 AS o_custkey", "'F' AS o_orderstatus", "100.5D AS o_totalprice", "date'1995-01-01' AS o_orderdate", "'5-LOW' AS o_orderpriority").write.parquet(f"{folder}/orders.parquet")
    league = bindings.League(spark, folder)
    lines = league.raw("lineitem")
    assert session.spread(lines, "l_orderkey", rows=10).rdd.getNumPartitions() == 100
    assert session.spread(lines, "l_orderkey").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert "RepartitionByExpression [l_orderkey" in league.stats._jdf.queryExecution().optimizedPlan().toString()
    assert league.stats.count() == 1000 and league.stats.select("game_id").distinct().count() == 1000


def test_cells_leave_python_with_the_stated_fields(spark):
    """Statistics are read from the texts of cells; their items stay behind, and the lines are the same."""
    line = "".join(f"<td>{c}</td>" for c in ["#4", "Silva (T)", "10:30", "5/9 (55,5)", "1/2 (50)", "1/3 (33,3)", "0/1 (0)", "1+2 3", *["1"] * 9])
    table = f"<table><thead><tr><th>Nr.</th><th>Jogador</th><th>Min</th><th>Pts</th></tr></thead><tbody><tr>{line}</tr></tbody></table>"
    pages = spark.createDataFrame([(1, table + table)], "page_id long, html string")
    whole, texts = extract.page_rows(pages), extract.page_rows(pages, extract.TEXTS)
    assert texts.schema["cells"].dataType.simpleString() == "array<struct<text:string>>"
    assert [c.text for c in texts.first().cells] == [c.text for c in whole.first().cells]
    lines = extract.boxscore_player_lines(texts).collect()
    assert len(lines) == 2 and sorted(lines) == sorted(extract.boxscore_player_lines(whole).collect())
    with pytest.raises(ValueError):
        extract.page_rows(pages, ("texts",))


def test_boxscores_are_read_from_tables_as_from_rows(spark):
    """A table leaves Python once with its header; pages are read once for printed and computed totals."""
    cells = lambda *first: "<tr>" + "".join(f"<td>{c}</td>" for c in [*first, "5/9 (55,5)", "1/2  (50)", " 1/3 (33,3)", "0/1 (0) ", "1+2  3", *["1"] * 9]) + "</tr>"
    head = "<thead><tr><th>Nr.</th><th>Jogador</th><th> Min</th><th>Pts</th></tr></thead>"
    table = f"<table>{head}<tbody>{cells('#4', 'Silva >  (T)', '10:30')}{cells('#5', '', '1')}{cells('', 'Ações coletivas', '')}{cells('', 'Total', '200')}</tbody></table>"
    other = f"<table>{head}<tr><td>a</td></tr>{cells('6', 'Zé&nbsp;B', '9,5')}</table>"
    pages = spark.createDataFrame([(1, f"<h1>x</h1><table></table>{table}{other}"), (1, other + table), (2, other + other + table), (None, table * 2)], "page_id long, html string")
    rows, tables = extract.page_rows(pages, extract.TEXTS), extract.page_tables(pages)
    assert tables.count() == 2 + 2 + 3 + 2
    for read in (extract.boxscore_player_lines, extract.printed_team_lines, extract.boxscore_team_lines):
        found = sorted(read(tables).collect(), key=repr)
        assert found and found == sorted(read(rows).collect(), key=repr) == sorted(read(extract.boxscore_rows(tables, 3)).collect(), key=repr)
    lines = extract.boxscore_player_lines(tables).filter("page_id = 2").select("player_name_raw", "minutes_decimal", "points", "three_pct", "total_rebounds").collect()
    assert [tuple(r) for r in lines] == [("Zé B", 9.5, 5, 50.0, 3)] * 2
    assert "MapInArrow" not in _plan(extract.boxscore_team_lines(tables))


def test_texts_of_pages_are_made_where_they_are_read(spark):
    """The filter on a page's text stays above the shuffle that spreads the few files."""
    games = spark.range(3).localCheckpoint()
    rows = extract.page_rows(on_pages._page(games, "'<h1>'", "id", "'</h1>'"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("RepartitionByExpression") and "RLIKE" not in plan[plan.index("RepartitionByExpression"):]
    assert sorted(r.cells[0].text for r in rows.collect()) == ["0", "1", "2"]


def _shuffles_by_number(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_rollups_stay_where_their_lines_were_dealt(spark):
    """Lines move once, into a stated number of tasks; all totals of a player are made there."""
    stats = spark.range(600).selectExpr(
        "id AS game_id", "id % 3 AS season_id", "id % 4 AS team_id", "id % 25 AS player_id", "concat('J', id % 25) AS player_name_raw", "'1' AS is_starter",
        "10.0D AS minutes_decimal", *[f"id % 5 AS {s}" for s in constants.STAT_INPUTS])
    players = spark.range(20).selectExpr("id", "concat('P', id) AS full_name", "cast(null AS string) AS display_name")
    teams = spark.range(4).selectExpr("id", "concat('T', id) AS canonical_name")
    seasons = spark.range(3).selectExpr("id", "concat('S', id) AS name")
    for rollup in (rollups.player_seasons, lambda rows: rollups.player_career_totals(rows, seasons)):
        dealt, plain = (rollup(rollups.player_team_seasons(stats, players, teams, seasons, tasks)) for tasks in (7, None))
        plan = _shuffles_by_number(dealt)
        assert "REPARTITION_BY_NUM" in plan and "Exchange hashpartitioning(season_id" not in plan
        order = [c for c in ("player_id", "season_id") if c in dealt.columns]
        assert dealt.orderBy(*order).collect() == plain.orderBy(*order).collect()
    by_team = rollups.player_team_seasons(stats, players, teams, seasons, 7)
    checks, whole = (quality.check_player_team_seasons(stats, by_team, tasks) for tasks in (7, None))
    assert "REPARTITION_BY_NUM" in _shuffles_by_number(checks) and sorted(checks.collect()) == sorted(whole.collect())


def test_numbering_in_a_stated_number_of_ranges(spark):
    rows = spark.range(500).selectExpr("(id * 37) % 500 AS k")
    numbered = positions.with_surrogate_id(rows, ["k"], tasks=7)
    assert [(r.id, r.k) for r in numbered.orderBy("k").collect()] == [(k + 1, k) for k in range(500)]


def _dear_filters(df) -> list[str]:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Filter " in line and ("translate(" in line or "regexp_replace(" in line)]


def test_names_are_read_once_a_row(spark):
    """Filters read the keys and cleaned names that were worked out; records move once, by name and player."""
    seen = spark.createDataFrame([(1, 4, 1, "ALFA"), (1, 4, 1, "ALFA"), (2, 5, 1, " ")], "id bigint, team_id bigint, season_id bigint, alias string").distinct()
    players = spark.createDataFrame([(1, "a", "Ana Lima"), (2, "b", "Bea"), (3, "c", " ")], "id bigint, slug string, full_name string").localCheckpoint()
    links = spark.createDataFrame([("a", 1, "Lima", "7", "Alfa", 2), ("a", 1, "LIMA", "7", "alfa", 1), ("b", 1, "Lima", "9", "Alfa", 3), ("b", 1, " ", "9", "Alfa", 4)],
                                  "player_slug string, season_id int, display_name string, jersey_number string, team_name_raw string, position int").localCheckpoint()
    there = spark.createDataFrame([], "player_id bigint, season_id bigint, alias string, alias_type string, jersey_number string, team_name_raw string, source string, is_primary bigint")
    aliases = merge.add_player_names(there, players, players.selectExpr("slug AS player_slug", "full_name"), links)
    assert not _dear_filters(aliases)
    assert {(r.player_id, r.alias) for r in aliases.collect()} == {(1, "Ana Lima"), (2, "Bea"), (1, "LIMA"), (2, "Lima")}
    records = resolve.name_records(players.select("id", "full_name"), aliases.drop("change").localCheckpoint(), seen)
    asked = spark.createDataFrame([(1, 4, "LIMA", "9"), (1, 4, "Lima", None), (1, 4, "bea", None), (1, 4, None, None)], "season_id bigint, team_id bigint, player_name_raw string, jersey_number string")
    dealt, plain = (resolve.resolve_requests(asked, records, tasks) for tasks in (7, None))
    assert {(r.player_name_raw, r.jersey_number): (r.player_id, r.reason) for r in dealt.collect()} == {
        ("LIMA", "9"): (2, "resolved"), ("Lima", None): (None, "ambiguous_match"), ("bea", None): (2, "resolved"), (None, None): (None, "empty_player_name")}
    assert sorted(dealt.collect(), key=repr) == sorted(plain.collect(), key=repr)
    assert not [line for line in _dear_filters(dealt) if "translate(" in line]
    plan = _shuffles_by_number(resolve.player_lookup(records, 7))
    assert "hashpartitioning(name_key" in plan and "REPARTITION_BY_NUM" in plan and not [
        line for line in plan.splitlines() if "Exchange" in line and "strategy" in line and "player_id" in line]


def test_names_of_candidates_are_read_once(league):
    """A name is worked out once per request, record and list of names; no filter works it out again."""
    groups, records = league
    pairs = similar._name_pairs(groups, records, 720, False)
    best = similar.best_candidates(groups, records, pairs, similar.SUGGEST_WEIGHTS, 2, True)
    assert not _dear_filters(best)
    assert {r.q_player_name_raw: r.player_id for r in best.filter("candidate_rank = 1").collect()} == {"João Silva": 1, "Pedro  Sousa": 3}


def test_identity_key_of_texts_with_any_white_space(spark):
    spaces = [chr(c) for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    rows = spark.createDataFrame([(t,) for s in spaces for t in (f"{s}Zé{s}{s}ΟΔΟΣ{s}", f"ΑΣ{s}ΣΑ{s}7", s)] + [(None,), ("",)], "t string")
    plain = F.nullif(F.regexp_replace(text.fold("t"), r"[^\p{L}\p{N}]+", ""), F.lit(""))
    assert rows.filter(~text.identity_key("t").eqNullSafe(plain)).isEmpty()
