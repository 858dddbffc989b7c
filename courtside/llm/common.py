"""Helpers shared by the operators: fixed character classes and tables written on the way."""

from __future__ import annotations

import pickle

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
#: A run of other than ASCII white space, as Spark's and DuckDB's pattern.
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and leave every other character."""
    return F.translate(text, UPPER, LOWER)


def text_key(text: Column) -> Column:
    """What tells rows of one doc_id, or without, apart: a hash of their text; null is as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder once and read it back.

    Later steps read the files, so a lost executor costs no earlier step, and no step
    runs twice.  The shuffle files behind the table go as soon as it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def first_per_group(df: DataFrame, group: str, order: str, count: int, shares: int = 16) -> DataFrame:
    """The first ``count`` rows of each group by ``order``, which no two rows of a group share.

    Each task keeps the first of its own rows, then each of ``shares`` shares of all tasks, then
    the group: a group that holds most rows sends its last task ``count * shares`` rows.
    """
    few = df.withColumn("__share", F.spark_partition_id() % shares)
    for by in ([group, "__share"], [group]):
        few = few.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("__place") <= count)
    return few.drop("__share", "__place")


def only_ids(docs: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """The rows of ``docs`` whose doc_id is (or is not) among ``ids``; a null id equals a null id.

    Only the columns of ``docs`` come back, whatever the names in ``ids``.
    """
    wanted = ids.select(F.col("doc_id").alias("__wanted_id"))
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["__wanted_id"]), "left_semi" if keep else "left_anti")


def sent(spark: SparkSession, model: object) -> Broadcast:
    """Broadcast a trained model, whose size is fixed, together with its class."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def received(model: Broadcast) -> object:
    return pickle.loads(model.value)
