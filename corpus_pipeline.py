"""From raw documents to a training mix: five operators, one after the other.

Each stage takes (spark, docs, folder) and returns a DataFrame; ``run`` writes it as Parquet
in the shared folder and reads it back as the next stage's documents, so a lost executor
costs no earlier stage.  All stages but the last return the columns of their documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtside.llm import decontaminate, exact_dedup, mixing, near_dedup, toxicity
from courtside.llm.common import only_ids, stored, text_key


def toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that a model of the labels rejects go; it learns as the registered query does."""
    held_out = toxicity.remainder(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs.where(~held_out), spark.read.parquet(f"{folder}/labels.parquet"))
    scored = toxicity.score(docs, model, "__toxicity")
    return scored.where(F.col("__toxicity") < toxicity.REJECT).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of documents that are linked by four fifths of their shingles of five words, the smallest id stays."""
    return only_ids(docs, near_dedup.near_groups(docs).where("not kept").select("doc_id").distinct(), keep=False)


def exact_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts the longest original stays, then the smallest id."""
    return exact_dedup.drop_copies(docs)


def leaked(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row per repetition of a document that the mix takes: its columns and ``copy``, from 1.

    A document is a doc_id with its text and source; equal rows are numbered through, and
    the first of them are repeated once more where the target is met among them.
    """
    key = ["doc_id", "text_key", "source"]
    plan = mixing.mix(docs, mixing.ranked_weights(docs)).groupBy(*[F.col(c).alias(f"__{c}") for c in key]).agg(
        F.min("repeats").alias("__least"), (F.sum("repeats") - F.min("repeats") * F.count("*")).alias("__more"))
    marked = docs.withColumn("__text", text_key(F.col("text")))
    same = marked["doc_id"].eqNullSafe(plan["__doc_id"]) & (marked["__text"] == plan["__text_key"]) & marked["source"].eqNullSafe(plan["__source"])
    joined = marked.join(plan.where("__least + __more > 0"), same)
    columns = [c for c in docs.columns if c != "copy"]
    # equal rows follow each other in the mix's order, so a source has them repeated unequally once at most
    place = F.row_number().over(Window.partitionBy("doc_id", "__text", "source").orderBy(F.lit(0)))
    uneven = joined.where("__more > 0").withColumn("__repeats", F.col("__least") + F.when(place <= F.col("__more"), 1).otherwise(0))
    taken = joined.where("__more = 0").withColumn("__repeats", F.col("__least")).unionByName(uneven).where("__repeats > 0")
    return taken.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__repeats").cast("int"))).alias("copy"))


STAGES = [
    ("toxicity", toxic),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", leaked),
    ("mixing", mixture),
]

#: Scores of a trained model decide in the first stage, so no SQL gives the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
