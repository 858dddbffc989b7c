"""Reading CSV tables as text, typing them by column name, writing tables."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import INTEGER_NAMES, MANUAL_TABLES, REAL_PARTS, TABLES
from .catalog import known_table


def path_exists(spark: SparkSession, path: str) -> bool:
    """Works for any file system Spark can reach."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def normalize_name(name: str) -> str:
    """Lower case, anything but letters and digits becomes a single underscore."""
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]+", "_", name.strip().lower())).strip("_")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename all columns; an empty header or two equal names are an error."""
    kept = [c for c in df.columns if c.strip()]
    names = [normalize_name(c) for c in kept]
    if not names:
        raise ValueError("table has no usable header")
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"columns are equal after normalisation: {repeated}")
    return df.select(*[F.col(f"`{c}`") for c in kept]).toDF(*names)


def infer_type(name: str) -> T.DataType:
    """Type of a column judged by its name alone."""
    name = normalize_name(name)
    if name in INTEGER_NAMES or name.endswith("_id"):
        return T.LongType()
    if any(part in name for part in REAL_PARTS):
        return T.DoubleType()
    return T.StringType()


def infer_types(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, infer_type(c)) for c in columns])


def coerce(c: Column, to: T.DataType) -> Column:
    """Blank -> NULL, comma decimals, integers truncated, unreadable -> NULL."""
    text = F.nullif(F.btrim(c), F.lit(""))
    if isinstance(to, T.StringType):
        return text
    number = F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
    return number.try_cast("bigint") if isinstance(to, T.LongType) else number


def coerce_values(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Type an all-text table, by default with the types its column names suggest."""
    schema = schema or infer_types(df.columns)
    types = {f.name: f.dataType for f in schema.fields}
    return df.select(*[coerce(F.col(c), types[c]).alias(c) for c in df.columns])


def read_table_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = (),
                   multi_line: bool = False) -> DataFrame:
    """A CSV table with every value as text.

    The header is read from the data; a leading byte-order mark is removed.  A
    missing path gives an empty table with the given columns.  ``multi_line``
    allows line breaks inside quoted values, at the price of unsplittable files.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def write_table(df: DataFrame, path: str, fields: list[str] | None = None,
                fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Replace a whole table; columns outside ``fields`` are left out.

    The rows are written to a folder beside ``path``, which takes its place by renames once
    the job has ended: a job that fails leaves the old table, and ``df`` may read it.  Between
    the two renames the old table stands at ``<path>.old-<id>``.
    """
    out = df.select(*fields) if fields else df
    writer = out.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    spark, version = df.sparkSession, uuid.uuid4().hex
    target, new, old = (spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in ("", f".new-{version}", f".old-{version}"))
    writer.save(new.toString())
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    there = files.exists(target)
    if there and not files.rename(target, old):
        raise OSError(f"{path} could not be set aside; the new table is at {new.toString()}")
    if not files.rename(new, target):
        back = there and files.rename(old, target)
        raise OSError(f"{new.toString()} could not take the place of {path}"
                      + ("" if back or not there else f"; the old table is at {old.toString()}"))
    if there:
        files.delete(old, True)


def ensure_table(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Create an empty table with the given header unless it exists; return it."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not path_exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.parquet(path)


def ensure_manual_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        name: ensure_table(spark, f"{folder}/{name}", columns)
        for name, columns in MANUAL_TABLES.items()
    }


def load_table(spark: SparkSession, name: str, csv_folder: str, out_folder: str) -> dict:
    """CSV -> typed Parquet for one table; the result says how it went."""
    source = f"{csv_folder}/{known_table(name)}.csv"
    status = {"table_name": name, "status": "missing_csv", "rows_imported": 0,
              "columns": 0, "error": None}
    if not path_exists(spark, source):
        return status | {"error": f"no such file: {source}"}
    try:
        typed = coerce_values(normalize_columns(read_table_csv(spark, source)))
        target = f"{out_folder}/{name}"
        write_table(typed, target)
        return status | {
            "status": "imported",
            "rows_imported": spark.read.parquet(target).count(),
            "columns": len(typed.columns),
        }
    except (ValueError, AnalysisException) as problem:
        return status | {"status": "error", "error": str(problem)}


def load_all(spark: SparkSession, csv_folder: str, out_folder: str) -> DataFrame:
    """Full refresh of every registered table; one status row per table."""
    rows = [load_table(spark, name, csv_folder, out_folder) for name in TABLES]
    return spark.createDataFrame(
        rows, "table_name string, status string, rows_imported bigint, columns int, error string"
    )


def table_counts(tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """Rows per registered table; -1 marks a table that is absent."""
    counts = [
        tables[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name in TABLES if name in tables
    ]
    absent = [(name, -1) for name in TABLES if name not in tables]
    if absent:
        counts.append(spark.createDataFrame(absent, "table_name string, rows bigint"))
    return reduce(DataFrame.unionByName, counts)
