"""Benchmark decontamination: windows of test items searched in training documents.

The benchmark's windows are a small table next to the corpus.  They are broadcast in
blocks of at most ``block_rows`` windows, so the broadcast has a fixed bound: a larger
benchmark takes one more pass over the corpus per block, and no window is left out.
Documents make their windows row by row inside one code-generated stage; only windows
whose hash is found and whose words are equal leave it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, text_key

#: What separates words once A to Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row per different window: size, words, hash, and the items that hold it.

    Items of fewer than ``n`` words, but not none, are one window.  Rows without item_id
    or text give no window.
    """
    items = benchmark.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")
    ).where(F.size("words") > 0)
    starts = items.select(
        "item", "words", F.least(F.lit(n), F.size("words")).alias("k"),
        F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - n + 1))).alias("at"),
    )
    grams = starts.select("item", "k", F.slice("words", F.col("at"), F.col("k")).alias("gram"))
    return grams.groupBy("k", "gram").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn(
        "h", F.xxhash64("gram"))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_rows: int = 500_000) -> DataFrame:
    """Per document: its word count, the spans of words hit and the items found.

    Columns doc_id, text_key, n_words (long), spans (array of structs ``first``, ``last``: 1-based
    word positions, both inclusive, sorted, not overlapping), n_hit (long, words in spans)
    and items (strings, sorted).  Null and empty texts have no words and no hits.  A
    document is a doc_id with a text, also where doc_id is null: equal rows give the result
    of one, and different texts of one doc_id a result each.  An empty benchmark hits nothing.
    """
    windows = benchmark_windows(benchmark, n)
    found = windows.groupBy("k").agg(F.count("*").alias("rows")).collect()  # one row per size, at most n
    sizes, blocks = sorted(r["k"] for r in found), -(-sum(r["rows"] for r in found) // block_rows) or 1
    words = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), words_of(F.col("text")).alias("words"))
    words = words.select("doc_id", "text_key", "words", F.size("words").alias("n_words"))
    # position 0 carries the document itself, hit or not
    at = words.select("doc_id", "text_key", "words", "n_words", F.explode(F.sequence(F.lit(0), F.col("n_words"))).alias("at"))
    if len(sizes) > 1:
        at = at.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    else:
        at = at.withColumn("size", F.lit(sizes[0] if sizes else n))
    at = at.where((F.col("at") == 0) | (F.col("at") + F.col("size") - 1 <= F.col("n_words")))
    # start 0 is no place to slice at: the document's own row hashes another window, and meets no item
    gram = F.slice("words", F.greatest(F.col("at"), F.lit(1)), F.col("size"))
    at = at.withColumn("hash", F.when(F.col("at") > 0, F.xxhash64(gram)))

    def searched(block: int) -> DataFrame:
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("gram", F.lit(1)), F.lit(blocks)) == block)
        # the words decide, the hash only finds; two bounds keep the comparison out of the join's keys
        same = (at["hash"] == part["h"]) & (at["size"] == part["k"]) & (gram >= part["gram"]) & (gram <= part["gram"])
        hits = at.join(F.broadcast(part), same, "left")
        return hits.where((F.col("at") == 0) | F.col("h").isNotNull()).select(
            "doc_id", "text_key", "n_words", "at", (F.col("at") + F.col("size") - 1).alias("last"), "items")

    hits = reduce(DataFrame.unionAll, [searched(b) for b in range(blocks)])
    grouped = hits.groupBy("doc_id", "text_key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("at") > 0, F.struct(F.col("at").alias("first"), "last")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # overlapping windows become one span: a window that begins inside the last span lengthens it
    merged = F.expr("""
        aggregate(spans, cast(array() as array<struct<first:int,last:int>>), (done, s) ->
            case when size(done) > 0 and s.first <= element_at(done, -1).last + 1
                 then concat(slice(done, 1, size(done) - 1), array(named_struct(
                        'first', element_at(done, -1).first, 'last', greatest(element_at(done, -1).last, s.last))))
                 else concat(done, array(s)) end)""")
    return grouped.withColumn("spans", merged).withColumn(
        "n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1)"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = 10) -> DataFrame:
    """The documents without what the benchmark holds, with the columns of ``docs``.

    ``remove="documents"`` drops every document with a hit.  ``remove="spans"`` keeps all
    documents and deletes the words hit, each with the separators that follow it.
    """
    hits = find_hits(docs, benchmark, n).where("n_hit > 0")
    cut = hits.select(F.col("doc_id").alias("__hit_id"), F.col("text_key").alias("__hit_key"), F.col("spans").alias("__spans"))
    found = docs["doc_id"].eqNullSafe(cut["__hit_id"]) & (text_key(docs["text"]) == cut["__hit_key"])
    if remove == "documents":
        return docs.join(cut, found, "left_anti")
    if remove != "spans":
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    joined = docs.join(cut, found, "left")
    # split() at words gives the separators around them: one more than there are words
    rest = F.expr(rf"""
        concat(element_at(split(text, r'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', -1), 1), array_join(transform(
            regexp_extract_all(text, r'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', 0), (w, i) ->
            case when exists(__spans, s -> i + 1 between s.first and s.last) then ''
                 else concat(w, element_at(split(text, r'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', -1), i + 2)) end), ''))""")
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(rest)
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])
