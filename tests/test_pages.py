from courtside.operators import extract
from courtside.plans import on_pages  # noqa: F401  (the generated pages are checked by SQL)

BASE = "https://example.org"


def _rows(spark, html):
    return extract.page_rows(spark.createDataFrame([(1, html)], "page_id bigint, html string"))


def test_untidy_markup(spark):
    html = """<table class=a><tr><td>1<td>x &amp; <b>y</b> z<tr><th>2</th><td><table><tr><td>inner</table></td></tr>
    <!-- <tr><td>no</td></tr> --><script>"<tr><td>no"</script></table><h1>#7 <i>Zé</i></h1><img src='p.png'>"""
    got = [(r.kind, [c.text for c in r.cells]) for r in _rows(spark, html).collect()]
    assert got == [("row", ["inner"]), ("row", ["1", "x & y z"]), ("row", ["2", "inner"]), ("h1", ["#7 Zé"]), ("img", [""])]


def test_scripts_entities_and_unclosed_elements(spark):
    html = "<table><tr><td>a&nbsp;&lt;b&gt;<script>if (x</td>) '<td>'</script> c<style>td</style><td title>d<br/>e</table><h1>t<p>u"
    got = [(r.kind, [c.text for c in r.cells]) for r in _rows(spark, html).collect()]
    assert got == [("row", ["a <b> c", "d e"]), ("h1", ["t u"])]


def test_batches_leave_by_bytes():
    import pyarrow as pa

    page = "<table>" + "<tr><td>some words in a cell</td></tr>" * 300 + "</table>"
    batch = pa.record_batch({"page_id": list(range(40)), "html": [page] * 40})
    sizes = [b.nbytes for b in extract._parse_batches(iter([batch]), limit=100_000)]
    assert len(sizes) > 8 and max(sizes) < 300_000
    assert sum(b.num_rows for b in extract._parse_batches(iter([batch]), limit=100_000)) == 40 * 300


def test_deep_and_unclosed_markup_takes_linear_time():
    import time

    def seconds(n):
        start = time.perf_counter()
        extract._page_records("<b>x</i>" * n + "<table>" + "<tr><td>y<td>z" * n)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 16 * max(seconds(10_000), 0.05)


def test_pages_without_tables_are_not_parsed(spark):
    assert _rows(spark, "<p>nothing</p>").isEmpty()


# an invented line: minutes and seconds, shots made and tried per kind, rebounds, and nine counts
SHOTS = {"three": (2, 5), "two": (4, 7), "ft": (5, 6)}
REBOUNDS = (3, 4)


def _shots(made, tried):
    return f"<td>{made}/{tried} ({100 * made / tried:.1f})</td>"


def _points(shots):
    worth = {"three": 3, "two": 2, "ft": 1}
    return tuple(sum(worth[k] * v[i] for k, v in shots.items()) for i in (0, 1))


def _line(clock, shots, rebounds, count):
    kinds = "".join(_shots(*shots[k]) for k in ("three", "two", "ft"))
    return f"<td>{clock}</td>{_shots(*_points(shots))}{kinds}<td>{rebounds[0]}+{rebounds[1]} {sum(rebounds)}</td>" + f"<td>{count}</td>" * 9


def _side(name, rows):
    body = "".join(f"<tr><td>{number}</td><td>{who}</td>{cells}</tr>" for number, who, cells in rows)
    return (f"<div class='stats_real_time_table_{name}'><table class='real_time_table_stats' idq='0'>"
            f"<thead><tr><th>Nr.</th><th>Jogador</th></tr></thead><tbody>{body}</tbody></table></div>")


def test_boxscore(spark):
    idle = "<td></td>" * 15
    twice = {k: (2 * made, 2 * tried) for k, (made, tried) in SHOTS.items()}
    team_only = "<td></td>" * 5 + "<td>1+2 3</td>" + "<td></td>" * 9
    home = _side("home", [
        ("# 31", "Ottoline (T)", _line("21:30", SHOTS, REBOUNDS, 1)), ("# 40", "Percival", idle),
        ("", "Ações coletivas", team_only), ("", "Total", _line("", twice, (8, 11), 2)),
    ])
    away = _side("away", [("# 52", "Wilhelmina", _line("21:30", SHOTS, REBOUNDS, 1))])
    rows = _rows(spark, home + away)
    players = {r.player_name_raw: r for r in extract.boxscore_player_lines(rows).collect()}
    assert set(players) == {"Ottoline", "Wilhelmina"}                            # who did not play is left out
    o = players["Ottoline"]
    assert (o.side, o.is_starter, o.jersey_number, o.minutes_decimal) == ("home", 1, "31", 21.5)
    assert (o.points, o.points_attempted) == _points(SHOTS)
    assert (o.fg_made, o.fg_attempted) == tuple(SHOTS["three"][i] + SHOTS["two"][i] for i in (0, 1))
    teams = {r.side: r for r in extract.boxscore_team_lines(rows).collect()}
    assert (teams["home"].points, teams["home"].total_rebounds, teams["home"].collective_total_rebounds) == (_points(twice)[0], 19, 3)
    assert (teams["away"].parse_model, teams["away"].points, teams["away"].collective_total_rebounds) == (
        "realtime_computed_total", _points(SHOTS)[0], None)
    assert extract.complete_boxscores(extract.boxscore_player_lines(rows), extract.boxscore_team_lines(rows)).count() == 1


def test_incremental_run(spark):
    """Two page files, taken in by two runs of the stream; the second changes a line."""
    from courtside.operators.merge import upsert
    from courtside.session import scratch_path
    from courtside.streaming import incremental
    from pyspark.sql import functions as F

    folder, table, state = (scratch_path(spark, n) for n in ("in", "table", "state"))
    empty = spark.createDataFrame([], "page_id bigint, url string, size bigint")

    def merge(current, pages):
        new = pages.select("page_id", "url", F.length("html").cast("bigint").alias("size"))
        return upsert(current, new, lambda df: [F.col("page_id")], ["page_id"]).drop("change")

    def run(rows):
        spark.createDataFrame(rows, incremental.PAGES_SCHEMA).write.mode("append").parquet(folder)
        stream = incremental.upsert_stream(incremental.page_stream(spark, folder), table, state, empty, merge)
        stream.awaitTermination()
        return {(r.page_id, r.size) for r in incremental.latest_version(spark, table, stream).collect()}

    assert run([(1, "u", "aa"), (2, "u", "b")]) == {(1, 2), (2, 1)}
    assert run([(2, "u", "bbb")]) == {(1, 2), (2, 3)}


def test_cells_of_a_game_are_found_once(spark):
    """Each named cell is looked up once for all columns; a class is one of the words, however they are set apart."""
    row = ("<tr><td class='x\tposition_value' data-real-id='G1'> 1&nbsp; a </td><td class='position_value2 home_team_value'><span class='team-shortname'>Um  A</span></td>"
           "<td class='visitor_team_value'><b class='team-shortname'>Dois</b></td><td class='score_value'><span class='home'>80</span><span class='away'> </span></td></tr>")
    page = f"<table class='a\ntable_matches_table'><tbody>{row}</tbody></table><table class='table_matches_tables'><tbody>{row}</tbody></table>"
    rows = extract.page_rows(spark.createDataFrame([(1, page)], "page_id long, html string"))
    games = extract.extract_games(rows, "https://example.org")
    plan = games._jdf.queryExecution().optimizedPlan().toString()
    assert max(plan.count(f", {c})") for c in ("home_team_value", "score_value")) <= 4  # the name stands twice in a lookup, and one more lookup is in the filter
    assert [(g.game_number, g.source_game_id, g.home_team_name_raw, g.away_team_name_raw, g.home_score, g.away_score, g.status) for g in games.collect()] == [
        ("1 a", "G1", "Um A", "Dois", "80", None, "scheduled")]
