import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from courtside.constants import STAT_INPUTS
from courtside.operators import positions, quality, query, records, rollups, standings

GAME = "id bigint, season_id bigint, competition string, phase string, home_team_id bigint, away_team_id bigint, home_score bigint, away_score bigint, game_date date"


@pytest.fixture
def games(spark):
    d = date(2020, 1, 1)
    rows = [
        (1, 1, None, "Turno", 1, 2, 80, 70, d), (2, 1, "NBB", "Turno", 2, 1, 75, 75, d), (3, 1, "NBB", "Turno", 3, 1, None, 90, d),
        (4, 1, "NBB", "Turno", None, 1, 80, 90, d), (5, 1, "NBB", "Quartas de final", 1, 3, 90, 80, d), (6, 1, "NBB", "Final", 1, 2, 90, 80, d),
        (7, 1, "NBB", "Final", 2, 1, 90, 80, d), (8, 1, "NBB", "Turno", 3, 2, 60, 50, d),
        (9, 2, "NBB", "Turno", 1, 2, 80, 70, d), (10, 2, "NBB", "Final", 1, 2, 80, 70, d), (11, 2, "NBB", "Turno", 3, 2, 71, 70, d),
        (12, 3, "NBB", "Turno", 1, 2, 80, 70, d), (13, 3, "NBB", "Semifinal", 2, 3, 80, 70, d),
    ]
    return spark.createDataFrame(rows, GAME)


@pytest.fixture
def teams(spark):
    return spark.createDataFrame([(1, "Alfa"), (2, "Beta"), (3, None)], "id bigint, canonical_name string")


@pytest.fixture
def seasons(spark):
    return spark.createDataFrame([(1, "2019-20", 0), (2, "2020-21", 0), (3, "2021-22", 1)], "id bigint, name string, is_current int")


def test_standings(games, teams, seasons):
    rows = {(r.season_id, r.team_id): r for r in standings.standings(games, teams, seasons).collect()}
    first = rows[1, 1]
    assert (first.games_played, first.wins, first.losses, first.home_record, first.away_record) == (2, 1, 1, "1-0", "0-1")   # a draw is a loss
    assert rows[1, 2].losses == 3 and rows[1, 3].games_played == 1                          # unfinished games do not count
    assert [rows[1, t].finish_stage for t in (1, 2, 3)] == ["vice-campeão", "vice-campeão", "quartas"]   # 1-1 final: no champion
    assert [rows[2, t].finish_stage for t in (1, 2, 3)] == ["campeão", "vice-campeão", "não classificou"]
    assert rows[3, 1].finish_stage == "em andamento" and rows[3, 1].finish_stage_order == -1 and rows[3, 1].qualified_playoffs == 0
    assert rows[3, 2].finish_stage == "semifinal"
    assert [rows[1, t].rank for t in (3, 1, 2)] == [1, 2, 3]


def test_standings_agree_with_their_parts(games, teams, seasons):
    key = standings.TABLE_KEY
    whole = standings.standings(games, teams, seasons)
    table = standings.regular_season_table(games)
    assert whole.select(*key, "wins", "point_diff").exceptAll(table.select(*key, "wins", "point_diff")).isEmpty()
    finish = standings.postseason_finish(games).select(*key, "finish_stage")
    assert whole.filter("finish_stage_order > 0").select(*key, "finish_stage").exceptAll(finish).isEmpty()


def test_rank_chain(spark):
    rows = [(1, "c", 1, 4, 2, 5, 100, "b"), (1, "c", 2, 4, 2, 5, 100, "a"), (1, "c", 3, 2, 1, 9, 50, "z"), (1, "c", 4, 4, 2, 6, 10, "z"), (1, "c", 5, 4, 2, 5, 101, "z")]
    df = spark.createDataFrame(rows, "season_id int, competition string, team_id int, games_played int, wins int, point_diff int, points_for int, team_name string")
    assert [r.team_id for r in standings.standings_rank(df).orderBy("rank").collect()] == [4, 5, 2, 1, 3]


def _stats(spark, rows):
    """(game, season, team, player, name, starter, minutes, points)"""
    df = spark.createDataFrame(rows, "game_id bigint, season_id bigint, team_id bigint, player_id bigint, player_name_raw string, is_starter string, minutes_decimal double, points bigint")
    zeros = {s: F.lit(None).cast("bigint") for s in STAT_INPUTS if s != "points"}
    return df.withColumns(zeros)


@pytest.fixture
def stats(spark):
    return _stats(spark, [
        (1, 1, 1, 7, "Zé", "sim", 10.0, 8), (1, 1, 1, 7, "Zé", "0", 5.0, 2), (2, 1, 2, 7, "Ze", "1", 20.0, 10), (6, 1, 1, 8, "Ana", "1", None, None),
        (9, 2, 2, 7, "Zé", "1", 30.0, 10), (9, 2, None, 7, "x", "1", 1.0, 1), (9, None, 2, 7, "x", "1", 1.0, 1), (9, 2, 2, None, "x", "1", 1.0, 1), (9, None, None, None, "x", "1", 1.0, 1),
    ])


@pytest.fixture
def players(spark):
    return spark.createDataFrame([(7, None, " "), (8, "Ana Lima", None)], "id bigint, full_name string, display_name string")


def test_rollups(spark, stats, players, teams, seasons):
    by_team = rollups.player_team_seasons(stats, players, teams, seasons).cache()
    r = by_team.filter("season_id = 1 AND team_id = 1 AND player_id = 7").first()
    assert (r.games_played, r.games_started, r.points_total, r.minutes_total, r.points_per_game) == (1, 1, 10, 15.0, 10.0)   # same game twice
    assert r.player_name == "Zé" and r.fg_pct is None and r.assists_total == 0
    assert {(x.reason, x.rows) for x in rollups.skipped_rows(stats).collect()} == {("missing_player_id", 2), ("missing_team_id", 1), ("missing_season_id", 1)}
    s = rollups.player_seasons(by_team).filter("season_id = 1 AND player_id = 7").first()
    assert (s.primary_team_id, s.team_ids, s.team_names, s.teams_count, s.points_total) == (1, "1|2", "Alfa|Beta", 2, 20)     # equal games: smaller id
    c = rollups.player_career_totals(by_team, seasons).filter("player_id = 7").first()
    assert (c.first_season_id, c.last_season_id, c.seasons_count, c.points_total, c.last_season_name) == (1, 2, 2, 30, "2020-21")
    assert quality.check_player_team_seasons(stats, by_team).filter("check = 'ok'").first().rows == 1
    assert quality.check_player_team_seasons(stats, by_team.filter("season_id = 1")).filter("check = 'missing'").first().rows == 1


def test_records(spark, stats, games, players, teams, seasons):
    rows = {(r.player_id, r.scope, r.season_id, r.record_type): r for r in records.player_records(stats, games, players, teams, seasons).collect()}
    best = rows[7, "career", None, "points"]
    assert (best.value, best.tie_count, best.game_id, best.home_away, best.result, best.opponent_team_name) == (10.0, 2, 9, "away", "L", "Alfa")
    blank = rows[8, "season", 1, "assists"]
    assert (blank.value, blank.tie_count, blank.result) == (0.0, 1, "W")
    assert len([k for k in rows if k[1] == "career"]) == 16


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), F.lit(1).alias("same"))
    numbered = positions.with_surrogate_id(df, ["k"])
    got = [(r.id, r.k) for r in numbered.orderBy("id").collect()]
    assert [i for i, _ in got] == list(range(1, 1001)) and [k for _, k in got] == sorted(k for _, k in got)


def test_reading(spark, stats, games, teams):
    assert query.clamp_page(0, -1) == (1, 0) and query.clamp_page(5000, 3) == (1000, 3)
    people = spark.createDataFrame([(1, "José"), (2, "100%"), (3, "ANA")], "id bigint, full_name string")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(query.text_search(people, "jose", ("full_name",))) == [] and ids(query.text_search(people, "jose", ("full_name",), True)) == [1]
    assert ids(query.text_search(people, "%", ("full_name",))) == [2] and ids(query.text_search(people, "  ", ("full_name",))) == []
    assert ids(query.equality_filters(people, id=3, other=1, full_name=None)) == [3]
    assert ids(query.list_games(games, 1, 3)) == [8, 5, 3]
    assert query.rank_by_metric(stats, "points", ["game_id"], limit=1).first().points == 10
    h2h = query.head_to_head(stats.unionByName(stats.filter("player_id = 7 AND game_id = 2").withColumn("player_id", F.lit(8)).withColumn("team_id", F.lit(1))), games, 7, 8)
    assert {r.game_id for r in h2h.collect()} == {2}
    same_team = stats.unionByName(stats.filter("player_id = 7 AND game_id = 2").withColumn("player_id", F.lit(8)))
    assert query.head_to_head(same_team, games, 7, 8).isEmpty()


def test_lines_are_scanned_once_per_rollup(spark):
    """The rollups read the fact table once, records twice, the rollup's check once per side."""
    from courtside.plans import registry

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    scans = lambda name: registry.queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")
    assert {n: scans(n) for n in ("player_team_seasons", "player_seasons", "player_career_totals", "player_records", "check_player_team_seasons")} == {
        "player_team_seasons": 1, "player_seasons": 1, "player_career_totals": 1, "player_records": 2, "check_player_team_seasons": 2}


def test_nameless_players_get_their_most_frequent_name(spark):
    from courtside.constants import MINUTES, STAT_INPUTS

    rows = [(g, 1, 1, 9, name) for g, name in ((1, "B"), (1, "A"), (2, "B"), (3, "A"), (4, None))] + [(5, 1, 1, 8, "other")]
    stats = spark.createDataFrame(rows, "game_id long, season_id long, team_id long, player_id long, player_name_raw string").withColumns(
        {c: F.lit(1) for c in (*STAT_INPUTS, MINUTES)} | {"is_starter": F.lit("1")})
    players = spark.createDataFrame([(9, None, " "), (8, "Known", None)], "id long, full_name string, display_name string")
    teams = spark.createDataFrame([(1, "T")], "id long, canonical_name string")
    seasons = spark.createDataFrame([(1, "S")], "id long, name string")
    got = {r.player_id: (r.player_name, r.games_played, r.games_started, r.points_total) for r in rollups.player_team_seasons(stats, players, teams, seasons).collect()}
    assert got == {9: ("A", 4, 5, 5), 8: ("Known", 1, 1, 1)}


def test_a_repeated_run_replaces_its_row(spark, tmp_path):
    from datetime import datetime

    from courtside.operators import merge

    log = str(tmp_path / "runs")
    change = spark.createDataFrame([("inserted",), ("updated",), ("unchanged",)], "change string")
    failed = spark.createDataFrame([(1,)], "game_id long")
    merge.start_run(spark, log, 7, "games", "games", datetime(2020, 1, 1))
    merge.start_run(spark, log, 8, "lines", "lines", datetime(2020, 1, 2))
    for _ in range(2):
        merge.finish_run(spark, log, 7, change, failed, datetime(2020, 1, 3))
    got = {r.run_id: (r.status, r.started_at, r.finished_at, r.items_found, r.items_failed) for r in merge.read_runs(spark, log).collect()}
    assert got == {7: ("partial", datetime(2020, 1, 1), datetime(2020, 1, 3), 3, 1), 8: ("running", datetime(2020, 1, 2), None, None, None)}
    with pytest.raises(ValueError):
        merge.finish_run(spark, log, 9, change, failed, datetime(2020, 1, 3))


def test_review_lists_what_a_plain_search_lists(spark):
    """The threshold join against every pair of group and record, with names, blanks and ties of all kinds."""
    import random

    from courtside.operators import similar

    rng = random.Random(2)
    names = ["joao silva", "joão da silva", "silva", "maria souza", "mario sousa", "ze", "ana", "carlos alberto lima", "c lima", "xyzw"]
    pick = lambda values: rng.choice(values)
    request = lambda: (pick([1, 2]), pick([1, 2, None]), pick(names + [" "]), pick(["4", "5", None]))
    groups = spark.createDataFrame(sorted({request() for _ in range(60)}, key=repr), "season_id long, team_id long, player_name_raw string, jersey_number string")
    records = spark.createDataFrame([(i, pick(names), pick([1, 2, None]), pick([1, 2, None]), pick(["4", "5", "6", None]), "s") for i in range(80)],
                                    "player_id long, name string, season_id long, team_id long, jersey_number string, source string")
    got = {}
    for r in similar.top_candidates(groups, records).collect():
        got.setdefault((r.season_id, r.team_id, r.player_name_raw, r.jersey_number), []).append((r.player_id, r.score and round(r.score, 6)))
    pairs = groups.select(*[F.col(c).alias(f"q_{c}") for c in groups.columns]).join(records, F.lit(True))
    alike = similar.review_similarity(similar.norm_name("q_player_name_raw"), similar.norm_name("name"))
    want = {tuple(r): [] for r in groups.collect()}
    weights = similar.REVIEW_WEIGHTS
    for r in pairs.withColumn("alike", F.coalesce(alike, F.lit(0.0))).collect():
        score = r.alike * 100 + sum(weights[f][0] if r[f] == r[f"q_{f}"] else weights[f][1] for f in weights if r[f] is not None)
        if score >= 65:
            want[r.q_season_id, r.q_team_id, r.q_player_name_raw, r.q_jersey_number].append((-round(score, 6), r.player_id))
    assert got.keys() == want.keys()
    for key, listed in want.items():
        best = [-s for s, _ in sorted(listed)[:8]]
        assert sorted((s for _, s in got[key] if s is not None), reverse=True) == best, key
        assert {(p, s) for p, s in got[key] if s is not None} <= {(p, -s) for s, p in listed}
