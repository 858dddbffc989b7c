"""Session defaults and the scratch folder shared by driver and executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# lines become five times as wide when their statistics are computed, and an aggregate by game keeps every one of them
ROWS_PER_TASK = 200_000


def get_session(app: str = "courtside", **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Shuffle partitions are left to the cluster: adaptive execution coalesces
    small ones and splits skewed ones, so the initial number only has to be
    large enough for the biggest shuffle.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", "32m")  # pages reach Python in batches of bytes, not rows
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local folder would be lost with its machine, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", ""
    )
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = os.path.join(tempfile.gettempdir(), "courtside-checkpoints")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table written on the way."""
    return f"{checkpoint_root(spark)}/courtside/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a table to the shared folder once and read it back.

    Later steps read the files: a lost executor costs no earlier step, no step runs
    twice, and a reader takes only the columns and rows it needs.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def expanded(df: DataFrame) -> DataFrame:
    """A table to be joined by sorting, whatever the planner takes its size to be.

    The planner knows the bytes of a compressed file, not what repeated values or ``explode`` make of
    them, and would collect such a table on the driver to broadcast it.
    """
    return df.hint("merge")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns whose expressions are worked out once a row.

    The planner moves a filter on a column below joins and ``distinct`` and works out the column's
    expression in it again, on all the rows there.  A column that comes out of ``inline`` is only read.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def tasks_for(table: DataFrame, rows: int = ROWS_PER_TASK) -> int:
    """Tasks of about ``rows`` rows for a table read from files, at least one a core.

    Counting the rows of Parquet files reads their footers only.
    """
    return max(-(-table.count() // rows), table.sparkSession.sparkContext.defaultParallelism)


def spread(table: DataFrame, *keys: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """A table read from files, dealt by keys over tasks of about ``rows`` rows, at least one a core.

    Adaptive execution sizes tasks by compressed bytes, of which narrow rows have few; what a task
    then holds of the wider rows made from them grows to gigabytes.  A stated number of partitions
    is left as it is.
    """
    return table.repartition(tasks_for(table, rows), *keys)
