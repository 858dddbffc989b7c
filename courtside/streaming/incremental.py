"""The daily update as a stream of page files.

Pages arrive as files; each micro-batch is parsed, resolved and upserted into the
facts.  With ``availableNow`` the query handles what is new and stops, which is the
batch chain's incremental run with exactly-once bookkeeping of the files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import path_exists

PAGES_SCHEMA = "page_id bigint, url string, html string"


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(PAGES_SCHEMA).parquet(folder)


def upsert_stream(pages: DataFrame, table_folder: str, checkpoint: str, empty: DataFrame,
                  merge: Callable[[DataFrame, DataFrame], DataFrame]) -> StreamingQuery:
    """Run ``merge(current table, new pages)`` per micro-batch.

    Each batch writes a whole new version under ``table_folder/v<batch>`` from the
    version before.  A batch that is repeated after a failure rewrites the same
    folder from the same input, so the result does not depend on retries.
    """
    spark = pages.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        before = f"{table_folder}/v{batch_id - 1}"
        if batch_id > 0 and not path_exists(spark, before):
            raise RuntimeError(f"{before} is missing: starting again from an empty table would lose all rows")
        current = spark.read.parquet(before) if batch_id > 0 else empty
        merge(current, batch).write.mode("overwrite").parquet(f"{table_folder}/v{batch_id}")

    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_version(spark: SparkSession, table_folder: str, query: StreamingQuery) -> DataFrame:
    """The table after the last batch of a finished query."""
    done = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.parquet(f"{table_folder}/v{done}")
