"""URL rules by host and path prefix, found with one sorted sweep.

A host is read from its end (``www.example.org`` -> ``org.example.www``), so that a rule
for a host and its path is a prefix of the keys it fits: an interval in sorted order, and
the intervals of two rules are nested or apart.  Each different (host, path) gives one key
per level of its host, up to the labels of the deepest rule, so subdomains need no further intervals.  Rules and keys are
range-partitioned together and swept in order: the last rule that began is the top of a
stack that holds it and all rules around it, and the deepest of them that still covers the
key is the answer.  Every partition starts with the stack that the partitions before it
left.  Neither side is broadcast, and a host with a third of all rows is spread over ranges
of its paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, stored



def host_of(url: Column) -> Column:
    """A-Z lower-cased, with a port or user part if there is one; '' for null or without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    """Reversed host, a byte that ends it, path: as bytes, sorted as such."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("\x00"), path).cast("binary")


def _stacks(rules: DataFrame) -> DataFrame:
    """Each rule with the rules of its host whose path begins its own, shortest first, itself last."""
    around = rules.select("host", "path", F.explode(F.expr(
        "transform(sequence(0, length(path)), n -> substring(path, 1, n))")).alias("shorter"))
    held = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "action")
    frame = F.struct(F.length("p").alias("length"), F.col("p").alias("path"), "action")
    return around.join(held, (around["host"] == held["h"]) & (around["shorter"] == held["p"])).groupBy("host", "path").agg(
        F.array_sort(F.collect_list(frame)).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule (host and path, null if none), verdict.

    ``rules`` has host, path (strings) and action; a rule fits its host and all subdomains
    if the path begins with the rule's.  The longest (code points of host and path, then of
    the host) wins; of rules with equal host and path, ``block`` wins over others, then the
    smaller action.  Rows without url, or whose url has no ``://``, have an empty host and
    path and get ``default`` unless a rule has an empty host.  Repeated rows are judged each.
    """
    spark = pages.sparkSession
    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = rules.where(F.col("host").isNotNull()).select(
        lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
    rules = rules.groupBy("host", "path").agg(
        F.when(F.max((F.col("action") == "block").cast("int")) == 1, F.lit("block")).otherwise(F.min("action")).alias("action"))
    # copies of an address are judged once
    asked = urls.select("host", "path").distinct()
    # only as many last labels as the deepest rule has can be a rule's host: one number, so a long host gives few keys
    deepest = rules.agg(F.max(F.size(F.split("host", "[.]")))).first()[0] or 1
    labels = asked.select("host", "path", F.split("host", "[.]").alias("labels"))
    labels = labels.select("host", "path", F.slice("labels", F.greatest(F.lit(1), F.size("labels") - deepest + 1), F.lit(deepest)).alias("labels"))
    levels = labels.select("host", "path", F.explode(F.expr(
        "transform(sequence(1, size(labels)), n -> array_join(slice(labels, n, size(labels)), '.'))")).alias("level"))
    points = levels.select(_key(F.col("level"), F.col("path")).alias("key"), F.lit(1).alias("kind"), "host", "path", "level",
                           F.lit(None).cast("array<struct<length:int,path:string,action:string>>").alias("stack"))
    starts = _stacks(rules).select(_key(F.col("host"), F.col("path")).alias("key"), F.lit(0).alias("kind"),
                                   "host", "path", F.col("host").alias("level"), "stack")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, so that all steps see one division into ranges
    line = stored(points.unionAll(starts).repartitionByRange(parts, "key", "kind").withColumn("part", F.spark_partition_id()), "url-line")
    # the stack that a part begins with: the last one of the parts before it; one row a part
    left = line.where("kind = 0").groupBy("part").agg(F.max_by(F.struct("level", "stack"), "key").alias("last"))
    left = line.select("part").distinct().join(left, "part", "left").select("part", F.last("last", True).over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    order = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = line.withColumn("seen", F.last(F.when(F.col("kind") == 0, F.struct("level", "stack")), True).over(order))
    swept = swept.where("kind = 1").join(left, "part").withColumn("seen", F.coalesce("seen", "carried"))
    covering = F.expr("try_element_at(filter(seen.stack, r -> seen.level = level and startswith(path, r.path)), -1)")
    fits = swept.select("host", "path", "level", covering.alias("rule")).where("rule is not null")
    size = F.length("level") + F.col("rule.length")
    best = fits.groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.max(F.struct(
        size, F.length("level"), F.concat("level", "rule.path").alias("rule"), F.col("rule.action").alias("action"))).alias("best"))
    return urls.join(best, (urls["host"] == best["r_host"]) & (urls["path"] == best["r_path"]), "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
