"""Raw web pages as a table, and the manifest of what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def page_source(spark: SparkSession, path: str, name_pattern: str | None = None) -> DataFrame:
    """Pages as (page_id, url, html).

    ``path`` is a Parquet table of pages, or, with ``name_pattern``, a folder of
    cached HTML files whose id is the pattern's first group.
    """
    if name_pattern is None:
        return spark.read.parquet(path).select("page_id", "url", "html")
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
    )
    key = F.regexp_extract("url", name_pattern, 1).try_cast("bigint")
    return files.select(key.alias("page_id"), "url", "html")


def page_manifest(pages: DataFrame, source_type: str, from_cache: bool = True) -> DataFrame:
    """One row per page: where it came from, its size and the hash of its content."""
    return pages.select(
        "page_id",
        F.lit(source_type).alias("source_type"),
        F.col("url").alias("source_url"),
        F.sha2(F.encode("html", "utf-8"), 256).alias("content_sha256"),
        F.length("html").cast("bigint").alias("html_size"),
        F.lit(int(from_cache)).alias("from_cache"),
    )


def changed_pages(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages whose content is not in the manifest yet: the input of an incremental run."""
    seen = manifest.select("page_id", "content_sha256").distinct()
    hashed = pages.withColumn("content_sha256", F.sha2(F.encode("html", "utf-8"), 256))
    return hashed.join(seen, ["page_id", "content_sha256"], "left_anti").drop("content_sha256")
