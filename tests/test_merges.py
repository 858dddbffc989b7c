"""Upserts by partition, aliases from pages, reviewed resolutions."""

import glob

import pytest
from pyspark.sql import functions as F

from courtside.operators import merge, resolve

ROW = "id bigint, slug string, season_id bigint, points bigint"


def slug_key(df):
    return [F.col("slug")]


def files(path):
    return {p for p in glob.glob(f"{path}/season_id=*/*.parquet")}


def content(spark, path):
    return sorted((tuple(r) for r in spark.read.parquet(path).select("slug", "season_id", "points").collect()), key=repr)


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "lines")
    rows = [(1, "a", 1, 5), (2, "b", 1, 6), (3, "c", 2, 7), (4, "d", 3, 8), (5, None, 3, 9), (6, "e", None, 1), (7, "f", 4, 2)]
    spark.createDataFrame(rows, ROW).write.partitionBy("season_id").parquet(path)
    return path


def test_only_touched_partitions_are_written(spark, stored):
    before = files(stored)
    run = spark.createDataFrame([("a", 1, 50), ("new", 5, 1)], "slug string, season_id bigint, points bigint")
    merged = merge.upsert_partitions(spark, stored, run, slug_key, ["points"])
    assert {r.slug: r.change for r in merged.collect()} == {"a": "updated", "b": "unchanged", "new": "inserted"}
    assert content(spark, stored) == sorted([("a", 1, 50), ("b", 1, 6), ("c", 2, 7), ("d", 3, 8), (None, 3, 9), ("e", None, 1), ("f", 4, 2), ("new", 5, 1)], key=repr)
    old = {p for p in before if "season_id=1/" not in p}
    assert old <= files(stored) and not (before - old) & files(stored)
    again = merge.upsert_partitions(spark, stored, run, slug_key, ["points"])
    assert {r.change for r in again.collect()} == {"unchanged"}


def test_a_row_moves_to_another_partition(spark, stored):
    run = spark.createDataFrame([("c", 3, 70), ("e", 1, 10)], "slug string, season_id bigint, points bigint")
    merge.upsert_partitions(spark, stored, run, slug_key, ["points"])
    assert content(spark, stored) == sorted([("a", 1, 5), ("b", 1, 6), ("e", 1, 10), ("c", 3, 70), ("d", 3, 8), (None, 3, 9), ("f", 4, 2)], key=repr)
    assert not any("season_id=2/" in p or "HIVE_DEFAULT" in p for p in files(stored))


def test_an_empty_run_writes_nothing(spark, stored):
    before = files(stored)
    none = spark.createDataFrame([], "slug string, season_id bigint, points bigint")
    assert merge.upsert_partitions(spark, stored, none, slug_key, ["points"]).isEmpty() and files(stored) == before


ALIAS = "player_id bigint, season_id bigint, alias string, alias_type string, jersey_number string, team_name_raw string, source string, is_primary bigint"


def test_aliases_from_profiles_and_links(spark):
    players = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id bigint, slug string")
    profiles = spark.createDataFrame([("a", " Ana  Lima ", "Aninha"), ("b", "Bea", " "), ("c", "Cid", None), ("x", "Xis", "X")],
                                     "player_slug string, full_name string, display_name string")
    links = spark.createDataFrame([
        ("a", 1, "A. LIMA", "7", "Équipe", 2), ("a", 1, "A. Lima", "7", "Equipe", 1), ("a", 1, "A. Lima", "8", "Equipe", 3), ("a", 2, "A. Lima", "7", "Equipe", 4),
        ("b", 1, None, "7", "Equipe", 5), ("b", 1, "Bea", None, None, 6), ("b", 1, "bea", " ", None, 7)],
        "player_slug string, season_id int, display_name string, jersey_number string, team_name_raw string, position int")
    there = spark.createDataFrame([(2, None, "BEA", "full_name", None, None, "player_profile", 1)], ALIAS)
    rows = merge.add_player_names(there, players, profiles, links)
    found = {(r.player_id, r.season_id, r.alias, r.alias_type, r.jersey_number, r.team_name_raw, r.is_primary, r.change) for r in rows.collect()}
    assert found == {
        (2, None, "BEA", "full_name", None, None, 1, "unchanged"),
        (1, None, "Ana Lima", "full_name", None, None, 1, "inserted"), (1, None, "Aninha", "display_name", None, None, 0, "inserted"),
        (1, 1, "A. Lima", "stats_display_name", "7", "Equipe", 0, "inserted"), (1, 1, "A. Lima", "stats_display_name", "8", "Equipe", 0, "inserted"),
        (1, 2, "A. Lima", "stats_display_name", "7", "Equipe", 0, "inserted"), (2, 1, "Bea", "stats_display_name", None, None, 0, "inserted")}
    again = merge.add_player_names(rows.drop("change"), players, profiles, links)
    assert again.filter("change = 'inserted'").isEmpty()


def test_page_names_reach_the_resolver(spark):
    players = spark.createDataFrame([(1, "a", "Ana Lima"), (2, "b", "Bea")], "id bigint, slug string, full_name string")
    links = spark.createDataFrame([("a", 1, "Lima", "7", "Alfa", 1), ("b", 1, "Lima", "9", "Alfa", 2)],
                                  "player_slug string, season_id int, display_name string, jersey_number string, team_name_raw string, position int")
    profiles = players.select(F.col("slug").alias("player_slug"), "full_name")
    aliases = merge.add_player_names(spark.createDataFrame([], ALIAS), players, profiles, links)
    teams = spark.createDataFrame([(1, 4, 1, "ALFA")], "id bigint, team_id bigint, season_id bigint, alias string")
    asked = spark.createDataFrame([(1, 4, "LIMA", "9"), (1, 4, "Lima", None), (1, 4, "bea", None)], "season_id bigint, team_id bigint, player_name_raw string, jersey_number string")
    found = {(r.player_name_raw, r.jersey_number): (r.player_id, r.reason) for r in resolve.resolve_requests(asked, resolve.name_records(players, aliases, teams)).collect()}
    assert found == {("LIMA", "9"): (2, "resolved"), ("Lima", None): (None, "ambiguous_match"), ("bea", None): (2, "resolved")}


def test_reviewed_suggestions(spark):
    columns = "season_id bigint, team_id bigint, player_name_raw string, jersey_number string, decision string, approved string, suggested_player_id bigint"
    chosen = spark.createDataFrame([(1, 4, "Zé", "5", "manual", "1", 8), (1, 4, "Zé", "6", "manual", None, 9), (1, 4, "Zé", "5", "auto", None, 7)], columns)
    selected = merge.select_suggestions(chosen, auto=False, reviewed=True)
    lines = spark.createDataFrame([(1, 4, "ZE", "5", None), (1, 4, "ZE", "6", None), (1, 4, "ZE", "6", 3)],
                                  "season_id bigint, team_id bigint, player_name_raw string, jersey_number string, player_id bigint")
    players = spark.createDataFrame([(8, "José")], "id bigint, full_name string")
    aliases = spark.createDataFrame([], "player_id bigint, season_id bigint, team_id bigint, alias string, alias_type string, jersey_number string, team_name_raw string, source string")
    done = merge.apply_resolutions(lines, selected, players, aliases, decided_by=merge.REVIEWED)
    assert {(r.jersey_number, r.player_id) for r in done.collect()} == {("5", 8), ("6", 8), ("6", 3)}
    with pytest.raises(ValueError):
        merge.select_suggestions(spark.createDataFrame([(1, 4, "Zé", "5", "manual", "1", p) for p in (8, 9)], columns))
