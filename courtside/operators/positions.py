"""Numbering rows: per group, and over a whole table without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def top_per_group(df: DataFrame, keys: list, order: list[Column], n: int, position: str = "position") -> DataFrame:
    """The first ``n`` rows of each group, numbered.

    Spark keeps only ``n`` rows per group and task before the shuffle, so a group
    that holds most of the table still arrives as n rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(position, F.row_number().over(window)).filter(F.col(position) <= n)


def first_per_group(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of each group in a stated order (unlike ``dropDuplicates``)."""
    return top_per_group(df, keys, order, 1, "__first").drop("__first")


def with_surrogate_id(df: DataFrame, order: list, name: str = "id", start: int = 1, tasks: int | None = None) -> DataFrame:
    """Number all rows 1..n in a global order, in parallel.

    Rows are range-partitioned and sorted, numbered inside their partition, and
    shifted by the sizes of the partitions before.  The table of sizes has one row
    per partition, which bounds the broadcast.  ``order`` must identify rows.  Without
    ``tasks`` the planner sizes the partitions by compressed bytes.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    local = (
        df.repartitionByRange(*([tasks] if tasks else []), *keys).sortWithinPartitions(*keys)
        .withColumn("__row", F.monotonically_increasing_id())
        .withColumn("__part", F.spark_partition_id())
    )
    local = cut_lineage(local)
    sizes = local.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(
        Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__shift"))
    in_part = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        local.join(F.broadcast(shifts), "__part")
        .withColumn(name, F.col("__shift") + in_part + F.lit(start))
        .drop("__row", "__part", "__shift")
        .select(name, *df.columns)
    )
