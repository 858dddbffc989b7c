"""Merkle manifest of a table, and proofs of its rows.

Rows are leaves of one binary tree per group; the groups' roots are leaves of a last tree,
whose root stands for the table.  Every level pairs neighbours; a node without neighbour is
hashed alone.  Trees are built in blocks of consecutive nodes, a few levels a round, so a
group that holds most rows is many blocks.

Proofs are made per block of leaves as an octopus (the union of the paths that the block's
rows need, without what they can derive themselves): its coordinates are collected level by
level, fetched once by a join with the nodes, the inner nodes that the rows share are
derived once, and each row's own proof is read off them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Levels that a block spans: it holds up to 2 ** SPAN nodes.
SPAN = 12
#: Name of the tree over the groups' roots; a group's own is longer.
TOP = ""


class Manifest(NamedTuple):
    """``leaves``: tree, pos, size, up, tops, digest and the columns kept.  ``nodes``: tree, level, pos, size, digest.

    ``size`` counts the nodes of the tree at that level, ``up`` is the tree's place among
    ``tops`` trees.  ``root`` is None for an empty table.
    """

    leaves: DataFrame
    nodes: DataFrame
    root: str | None


def digest(columns: list[Column]) -> Column:
    """Lowercase hex sha256 of the columns: ``-`` for null, else UTF-8 byte count, colon, value."""
    as_text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in as_text]), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def raised(run: list[str]) -> list[str]:
    """The level above consecutive nodes that begin at an even place."""
    return [_hash("".join(run[i:i + 2])) for i in range(0, len(run), 2)]


def missing(places: list[int], size: int) -> list[tuple[int, int]]:
    """(level, place) of the nodes that the paths of ``places`` (ascending) need and cannot derive."""
    out, level = [], 0
    while size > 1:
        have = set(places)
        out += [(level, p ^ 1) for p in places if p ^ 1 < size and p ^ 1 not in have]
        places, size, level = sorted({p >> 1 for p in places}), (size + 1) // 2, level + 1
    return out


def derived(known: dict[tuple[int, int], str], places: list[int], size: int) -> list[str]:
    """Add all nodes above ``places`` to ``known``, which has their union of missing nodes; gives the root."""
    level = 0
    while size > 1:
        places = sorted({p >> 1 for p in places})
        for p in places:
            known[level + 1, p] = _hash(known[level, 2 * p] + (known[level, 2 * p + 1] if 2 * p + 1 < size else ""))
        size, level = (size + 1) // 2, level + 1
    return known[level, 0]


def path(known: dict[tuple[int, int], str], place: int, size: int) -> list[tuple[int, str]]:
    """Per level which side the sibling is on (0 left, 1 right, 2: there is none) and its digest."""
    out, level = [], 0
    while size > 1:
        other = place ^ 1
        out.append((other & 1, known[level, other]) if other < size else (2, ""))
        place, size, level = place >> 1, (size + 1) // 2, level + 1
    return out


def folded(leaf: str, siblings: list[tuple[int, str]]) -> str:
    """The root that a leaf and its siblings give."""
    return reduce(lambda h, s: _hash(h + s[1] if s[0] else s[1] + h), siblings, leaf)


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    """Rows with equal keys, which stand together; one group is held at a time."""
    group: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if group and any(row[k] != group[0][k] for k in keys):
                yield group
                group = []
            group.append(row)
    if group:
        yield group


_NODE = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("pos", pa.int64()), ("size", pa.int64()), ("digest", pa.string())])


def _risen(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """The levels above each block of nodes, up to its own root."""
    out: list[dict] = []
    for group in _groups(batches, "tree", "block"):
        run, pos, size = [r["digest"] for r in group], group[0]["pos"], group[0]["size"]
        for step in range(1, SPAN + 1):
            if size == 1:
                break
            run, pos, size = raised(run), pos // 2, (size + 1) // 2
            out += [{"tree": group[0]["tree"], "level": level + step, "pos": pos + i, "size": size, "digest": d} for i, d in enumerate(run)]
        if len(out) >= 1 << SPAN:
            yield pa.RecordBatch.from_pylist(out, _NODE)
            out = []
    yield pa.RecordBatch.from_pylist(out, _NODE)


def _numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Add ``pos``, the place of a row in its ``tree``, and ``size``, the rows of the tree.

    Rows are range-partitioned, also among equal ones, and counted per partition; a tree
    is cut wherever a partition ends.
    """
    rows = rows.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    keys = ["tree", *order, "__tie"]
    local = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns(
        {"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    local = stored(local.drop("__tie"), name)
    before, all_ = Window.partitionBy("tree").orderBy("__part"), Window.partitionBy("tree")
    runs = local.groupBy("tree", "__part").agg(F.min("__row").alias("first"), F.count("*").alias("n")).select(
        "tree", "__part", (F.sum("n").over(before) - F.col("n") - F.col("first")).alias("__shift"), F.sum("n").over(all_).alias("size"))
    return local.join(runs, ["tree", "__part"]).withColumn("pos", F.col("__row") + F.col("__shift")).drop("__row", "__part", "__shift")


def _blocks(rows: DataFrame) -> DataFrame:
    """Whole blocks in order, each in one task."""
    rows = rows.withColumn("block", F.shiftright("pos", SPAN))
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _nodes(leaves: DataFrame) -> DataFrame:
    """All nodes over numbered leaves, the leaves at level 0."""
    rows = leaves.select("tree", F.lit(0).alias("level"), "pos", "size", "digest")
    found, level = [rows], 0
    while True:
        above = stored(_blocks(rows.where("size > 1")).mapInArrow(
            partial(_risen, level=level), "tree string, level int, pos long, size long, digest string"), "manifest-nodes")
        found.append(above)
        level += SPAN
        rows = above.where((F.col("level") == level) & (F.col("size") > 1))
        if rows.isEmpty():
            return reduce(DataFrame.unionAll, found)


def build(rows: DataFrame, group: Column, order: Column, columns: list[Column], **keep: Column) -> Manifest:
    """The manifest of ``rows``: a leaf each, hashed over ``columns``, in one tree per ``group``.

    Leaves ascend by ``order`` (nulls first), equal ones by digest; groups ascend bytewise,
    null first.  ``keep`` names columns to carry with the leaves.  Equal rows are leaves each.
    """
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))  # "-" is smaller than "="
    hashed = stored(rows.select(tree.alias("tree"), order.alias("__order"), digest(columns).alias("digest"),
                                *[c.alias(n) for n, c in keep.items()]), "manifest-digests")
    leaves = stored(_numbered(hashed, ["__order", "digest"], "manifest-sorted").drop("__order"), "manifest-leaves")
    inner = _nodes(leaves)
    roots = inner.where("size = 1").select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "digest")
    tops = stored(_numbered(roots, ["of"], "manifest-roots"), "manifest-tops")
    upper = _nodes(tops)
    root = upper.where("size = 1").select("digest").first()
    place = tops.select(F.col("of").alias("tree"), F.col("pos").alias("up"), F.col("size").alias("tops"))
    return Manifest(leaves.join(place, "tree"), inner.unionAll(upper), root["digest"] if root else None)


_WANT = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("of", pa.string()), ("level", pa.int32()), ("pos", pa.int64())])


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches, "tree", "block"):
        first = group[0]
        below = missing(sorted({r["pos"] for r in group}), first["size"])
        above = missing([first["up"]], first["tops"])
        yield pa.RecordBatch.from_pylist(
            [{"tree": first["tree"], "block": first["block"], "of": of, "level": level, "pos": pos}
             for of, some in ((first["tree"], below), (TOP, above)) for level, pos in some], _WANT)


def _proven(batches: Iterator[pa.RecordBatch], root: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    kept = [n for n in schema.names if n not in ("leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified")]
    for group in _groups(batches, "tree", "block"):
        rows = [r for r in group if r["of"] is None]
        below = {(r["level"], r["pos"]): r["digest"] for r in group if r["of"] == r["tree"]}
        above = {(r["level"], r["pos"]): r["digest"] for r in group if r["of"] == TOP}
        size, up, tops = rows[0]["size"], rows[0]["up"], rows[0]["tops"]
        below |= {(0, r["pos"]): r["digest"] for r in rows}
        subroot = derived(below, sorted({r["pos"] for r in rows}), size)
        above[0, up] = subroot
        shared, last = derived(above, [up], tops), path(above, up, tops)
        out = []
        for r in rows:
            siblings = path(below, r["pos"], size) + last
            proof = [d for side, d in siblings if side < 2]
            # an unchanged leaf folds along the nodes just derived
            fold = shared if r["claim"] == r["digest"] else folded(r["claim"], siblings)
            out.append({n: r[n] for n in kept} | {
                "leaf": r["digest"], "subroot": subroot, "root": root, "proof": proof if "proof" in schema.names else None,
                "proof_sha256": _hash("".join(proof)), "folded_root": fold, "verified": fold == root})
        yield pa.RecordBatch.from_pylist([{n: row[n] for n in schema.names} for row in out], schema)


def prove(manifest: Manifest, wanted: DataFrame, keep: dict[str, pa.DataType], proofs: bool = True) -> DataFrame:
    """Prove some or all leaves: their ``keep`` columns, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``wanted`` has the columns of ``manifest.leaves`` and ``claim``, the digest to be
    verified.  ``proof`` lists the siblings from the leaf to the root; without ``proofs``
    it is left out.  A repeated leaf is proven each time; no wanted leaf gives no row.
    """
    spark = wanted.sparkSession
    columns = [*keep, "tree", "pos", "size", "up", "tops", "digest", "claim"]
    wanted = wanted.select(*columns).withColumn("block", F.shiftright("pos", SPAN))
    asked = wanted.select("tree", "block", "pos", "size", "up", "tops")
    asked = asked.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    coords = stored(asked.mapInArrow(_wanted, "tree string, block long, of string, level int, pos long"), "manifest-octopus")
    at = manifest.nodes.select(F.col("tree").alias("of"), "level", "pos", "digest")
    fetched = coords.join(at, ["of", "level", "pos"])
    both = wanted.withColumns({"of": F.lit(None).cast("string"), "level": F.lit(0)}).unionByName(fetched, allowMissingColumns=True)
    both = both.repartition("tree", "block").sortWithinPartitions("tree", "block")
    schema = pa.schema([*keep.items(), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                        *([("proof", pa.list_(pa.string()))] if proofs else []), ("proof_sha256", pa.string()),
                        ("folded_root", pa.string()), ("verified", pa.bool_())])
    names = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>"}
    return both.mapInArrow(partial(_proven, root=manifest.root, schema=schema), ", ".join(f"{f.name} {names[f.type]}" for f in schema))
