import pytest
from pyspark.sql import types as T

from courtside.session import scratch_path
from courtside.sources import catalog, pages, tables


def test_names_and_types():
    assert tables.normalize_name(" FG% ") == "fg" and tables.normalize_name("Player ID") == "player_id"
    kinds = [type(tables.infer_type(c)) for c in ("Team ID", "wins", "fg_pct", "plus_minus", "points_total")]
    assert kinds == [T.LongType, T.LongType, T.DoubleType, T.DoubleType, T.StringType]
    with pytest.raises(KeyError):
        catalog.known_table("nothing")


def test_sql_leaves_no_views(spark):
    before = {v.name for v in spark.catalog.listTables()}
    got = catalog.sql_over({"games": spark.range(3), "teams": spark.range(2)}, "SELECT count(*) AS n FROM {games} JOIN {teams} USING (id)")
    assert got.first().n == 2
    assert {v.name for v in spark.catalog.listTables()} == before
    with pytest.raises(KeyError):
        catalog.sql_over({"nothing": spark.range(1)}, "SELECT 1")


def test_header_checks(spark):
    with pytest.raises(ValueError):
        tables.normalize_columns(spark.createDataFrame([("1", "2")], "`a b` string, `A-B` string"))
    with pytest.raises(ValueError):
        tables.normalize_columns(spark.createDataFrame([("1",)], "` ` string"))


def test_coercion(spark):
    df = spark.createDataFrame([("10.0", "10,5", " x "), (" ", "abc", "")], "game_id string, avg string, name string")
    assert [tuple(r) for r in tables.coerce_values(df).collect()] == [(10, 10.5, "x"), (None, None, None)]


def test_csv_round_trip_and_missing_file(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame([(' a"b,', "1"), (None, "2")], "`Name ` string, id string")
    tables.write_table(df, path, ["Name ", "id"], fmt="csv")
    assert {tuple(r) for r in tables.read_table_csv(spark, path).collect()} == {(' a"b,', "1"), (None, "2")}
    empty = tables.read_table_csv(spark, path + "-none", ("id", "x"))
    assert empty.columns == ["id", "x"] and empty.isEmpty()


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.write_table(spark.range(5), path)
    with pytest.raises(Exception, match="no such row"):
        tables.write_table(spark.range(5).selectExpr("if(id = 4, raise_error('no such row'), id) AS id"), path)
    assert spark.read.parquet(path).count() == 5
    tables.write_table(spark.read.parquet(path).filter("id < 2"), path)
    assert spark.read.parquet(path).count() == 2


def test_manual_tables_are_kept(spark):
    folder = scratch_path(spark, "manual")
    first = tables.ensure_manual_tables(spark, folder)["awards"]
    assert first.isEmpty()
    spark.createDataFrame([tuple(["1"] * len(first.columns))], first.schema).write.mode("append").parquet(f"{folder}/awards")
    assert tables.ensure_manual_tables(spark, folder)["awards"].count() == 1


def test_changed_pages(spark):
    old = spark.createDataFrame([(1, "u", "<p>a"), (2, "u", "<p>b")], "page_id bigint, url string, html string")
    new = spark.createDataFrame([(1, "u", "<p>a"), (2, "u", "<p>B"), (3, "u", "")], old.schema)
    assert {r.page_id for r in pages.changed_pages(new, pages.page_manifest(old, "x")).collect()} == {2, 3}
