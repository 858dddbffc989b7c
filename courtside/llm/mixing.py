"""Mixing sources to target weights.

Capped water-filling gives each source a share of the words; a source below its cap is
taken in proportion to its weight, one at its cap as often as the cap allows.  Then every
document is repeated as often as the whole part of target / size says, and a seeded
selection of documents once more for the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, text_key

#: Documents that one bucket of the selection holds on average.
BUCKET_DOCS = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill(sources: DataFrame, total: int, max_epochs: int = 3) -> DataFrame:
    """Add ``target`` (double) to sources with ``source_size`` and ``weight`` (longs).

    The level is words per unit of weight.  Sources whose share exceeds ``max_epochs``
    times their size are clamped there, and the level rises over the others until none is
    above; each round is one aggregate over the sources, whose state is the level alone.
    """
    level, cap = 0.0, F.col("source_size") * max_epochs
    while True:
        over = F.lit(level) * F.col("weight") >= cap
        row = sources.agg(F.sum(F.when(over, cap)).alias("fixed"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if not row["weight"]:
            break
        risen = (total - (row["fixed"] or 0)) / row["weight"]
        if risen <= level:
            break
        level = risen
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")))


def mix(docs: DataFrame, weights: DataFrame, share: float = 1.0, max_epochs: int = 3, seed: int = 0) -> DataFrame:
    """Per document how often the mix takes it: doc_id, text_key, source, size, source_size, target, repeats, taken.

    ``weights`` has source and weight (positive long), one row per source; documents of
    other sources are not taken (target 0).  ``share`` is the mix's size over all words.
    The documents that are taken once more are the first of their source in the order of
    a seeded hash, up to the one whose middle passes the rest of the target, so a source
    misses its target by half a document at most.  The hash is of the doc_id, for rows
    without one of their text; ties go to the smaller doc_id, then the smaller text_key (a
    hash of the text, also returned), so only equal rows are one tie and reruns agree.  Null
    texts have size 0 and are taken like others, with taken 0; a null source is a source.
    """
    named = F.coalesce(F.col("doc_id").cast("string"), F.col("text_key"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), named)), 1, 15), 16, 10)
    # sizes are counted once; both later passes read a few numbers a document instead of its text
    sized = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "source", n_words(F.col("text")).alias("size"))
    sized = stored(sized.withColumn("draw", drawn.cast("long")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("long").alias("weight"))
    sources = stored(totals.join(w, totals["source"].eqNullSafe(w["w_source"])).drop("w_source"), "mix-sources")
    everything = totals.agg(F.sum("source_size")).first()[0] or 0
    targets = fill(sources, math.floor(everything * share), max_epochs)
    times = F.floor(F.col("target") / F.col("source_size"))
    targets = targets.select(
        F.col("source").alias("t_source"), "source_size", "target", "n_docs",
        F.when(F.col("source_size") > 0, times).otherwise(0).cast("long").alias("whole"),
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_DOCS)).cast("long")
    # the hash has 60 bits; a bucket is a range of it, so buckets are in the order of the hash
    placed = sized.join(targets, sized["source"].eqNullSafe(targets["t_source"]), "left").withColumn(
        "bucket", F.floor(F.col("draw") / F.lit(2.0**60) * buckets))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "words",
                       F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    placed = placed.join(sums, placed["source"].eqNullSafe(sums["b_source"]) & placed["bucket"].eqNullSafe(sums["b_bucket"]), "left")
    crossing = (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))
    row = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.where(crossing).withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(row), F.lit(0)))
    outside = placed.where(~F.coalesce(crossing, F.lit(False))).withColumn("ahead", F.col("before"))
    extra = F.when((F.col("rest") > 0) & (F.col("ahead") + F.col("size") / 2 <= F.col("rest")), 1).otherwise(0)
    repeats = F.coalesce(F.col("whole") + extra, F.lit(0)).cast("long")
    return inside.unionByName(outside).select(
        "doc_id", "text_key", "source", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"), repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))


def ranked_weights(docs: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Weights that repeat ``cycle`` over the sources by code point, null last.

    The ranking numbers the different sources, not the documents; it is one sorted list,
    as every plan of a mix is.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle)))
    return docs.select("source").distinct().select("source", F.element_at(F.array(*map(F.lit, cycle)), at + 1).alias("weight"))
