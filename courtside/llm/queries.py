"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, centroids, decontaminate, exact_dedup, language, manifest, mixing, near_dedup, oracles, secrets, substring_dedup, toxicity, url_rules, warc,
)

#: The rules of the URL query: host, path, action.
URL_RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    hits = decontaminate.find_hits(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql("select * from values " + ", ".join(map(str, URL_RULES)) + " as rules(host, path, action)")
    return url_rules.judge(_table(spark, folder, "pages"), rules)


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, folder, "documents"))
    count = lambda kind: F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}")
    listed = lambda spans: f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = ", ".join(f"'{k[0]}'" for k in secrets.BASE)
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.expr(listed(f"filter(spans, s -> s.kind in ({base}))")), 256).alias("base_sha256"),
        F.expr(listed("spans")).alias("spans"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.copy_groups(_table(spark, folder, "documents"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return mixing.mix(docs, mixing.ranked_weights(docs)).select("doc_id", "size", "source_size", "target", "taken")


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, folder, "documents")).drop("kept_text")


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without doc_id are neither learned from nor held out."""
    docs = _table(spark, folder, "documents")
    held_out = toxicity.remainder(F.col("doc_id"), 4) == 2
    found = language.identify(docs, language.fit(docs.where(~held_out)))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without doc_id are neither learned from nor held out."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    held_out = toxicity.remainder(F.col("doc_id"), 3) == 1
    found = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs.where(~held_out), labels))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"),
                        (F.col("toxicity") >= toxicity.REJECT).cast("int").alias("predicted"))


def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, folder, "documents"), size=4)


def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    found = centroids.cluster(_table(spark, folder, "embeddings"))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    named = F.get(F.array(*map(F.lit, names)), "cluster") if names else F.lit(None).cast("string")
    return found.assigned.withColumn("centroid_sha256", named)


def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = manifest.digest([c + 1 if i == 3 else c for i, c in enumerate(columns)])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claim = F.when(tampered, changed).otherwise(manifest.digest(columns))
    made = manifest.build(docs, F.col("lang"), F.col("doc_id"), columns, doc_id=F.col("doc_id").cast("long"), claim=claim)
    return manifest.prove(made, made.leaves, {"doc_id": pa.int64()}, proofs=False)


def op13_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text"), ranks)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_url_rules, op3_secrets, op4_exact_dedup, op5_mixing, op6_substring_dedup,
    op7_language, op8_warc, op9_toxicity, op10_near_dedup, op11_centroids, op12_manifest, op13_bpe,
)}
ORACLES = {
    "op1_decontaminate": oracles.DECONTAMINATE, "op2_url_rules": oracles.url_rules(URL_RULES),
    "op4_exact_dedup": oracles.EXACT_DEDUP, "op5_mixing": oracles.MIXING,
    "op6_substring_dedup": oracles.SUBSTRING_DEDUP, "op10_near_dedup": oracles.NEAR_DEDUP,
    "op11_centroids": oracles.CENTROIDS, "op12_manifest": oracles.MANIFEST,
}
