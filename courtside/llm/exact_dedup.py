"""Exact deduplication by a 128-bit hash of the normalised text.

Texts are grouped by their hash together with the normalised text itself, so the bytes
decide and the hash only deals the rows.  Each task first reduces its own copies to one
row; a text with a third of all rows reaches the shuffle once per task.  Which row stays
is a maximum of one number (length and id in a decimal), which the hash aggregate holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.positions import top_per_group
from .common import BLANKS, stored

_ID_SPAN = 2**64


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def copy_groups(docs: DataFrame, prefer: str = "longest") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size (long), kept, text_sha256.

    Of equal normalised texts the row with the most code points in the original text
    stays (``prefer="longest"``), then the smallest doc_id; with ``prefer="smallest_id"``
    the id alone decides.  Null and empty texts are equal to each other.  Repeated rows
    all count in group_size and all bear the verdict of their doc_id.  A row without
    doc_id stays only where no row of its group has one (keep_id is null then).
    """
    length = F.length(F.coalesce(F.col("text"), F.lit(""))) if prefer == "longest" else F.lit(0)
    rows = docs.select("doc_id", length.alias("len"), normalised(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", "len", "norm", F.unhex(F.md5("norm")).alias("md5"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    rank = F.col("len").cast("decimal(12,0)") * F.lit(str(_ID_SPAN)).cast("decimal(20,0)") - F.col("doc_id").cast("decimal(20,0)")
    groups = rows.groupBy("md5", "norm", "sha").agg(
        F.count("*").alias("group_size"), F.max("len").alias("len"), F.max(rank).alias("rank"),
        F.max(F.when(F.col("doc_id").isNotNull(), F.col("len"))).alias("named_len"))
    keep = (F.col("named_len").cast("decimal(12,0)") * F.lit(str(_ID_SPAN)).cast("decimal(20,0)") - F.col("rank")).cast("long")
    # groups of one md5 but other bytes are told apart by the second hash, where rows look up their group
    groups = groups.select(F.col("md5").alias("g_md5"), F.col("sha").alias("g_sha"), "group_size", keep.alias("keep_id"))
    ids = rows.select("doc_id", "md5", "sha")
    return ids.join(groups, (ids["md5"] == groups["g_md5"]) & (ids["sha"] == groups["g_sha"])).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, prefer: str = "longest") -> DataFrame:
    """The documents that stay, with the columns of ``docs``: one row of each normalised text.

    Rows are decided by doc_id and text together, so an id that stands for several texts, or a
    missing one, keeps each text whose group it leads.  Of rows that repeat a kept id with
    its text, one stays, by ``prefer`` and then by the text itself.
    """
    # small next to the texts, and read by both branches
    keys = copy_groups(docs, prefer).where("kept").groupBy(F.col("doc_id").alias("__k_id"), F.col("text_sha256").alias("__k_sha"))
    keys = stored(keys.agg(F.count("*").alias("__rows")), "exact-kept")
    rows = docs.withColumn("__sha", F.sha2(normalised(F.col("text")), 256))
    same = (rows["__sha"] == keys["__k_sha"]) & rows["doc_id"].eqNullSafe(keys["__k_id"])
    once = rows.join(keys.where("__rows = 1"), same, "left_semi")
    if keys.where("__rows > 1").isEmpty():
        return once.drop("__sha")
    order = [F.desc(F.length(F.coalesce(F.col("text"), F.lit(""))))] if prefer == "longest" else []
    twice = top_per_group(rows.join(keys.where("__rows > 1"), same, "left_semi"), ["doc_id", "__sha"], [*order, F.col("text")], 1, "__pos")
    return once.drop("__sha").unionByName(twice.drop("__sha", "__pos"))
