"""Near-duplicate documents by SetSketch registers.

Each distinct word shingle of a document draws the points of a Poisson process, a register
for each; a register keeps its smallest point, truncated to an exponent of ``BASE``.  Such
registers are mergeable, and two documents agree in a register about as often as their
sets overlap.  Bands of registers find candidates; before any set is read, the likelihood
of all registers together with the known set sizes estimates the overlap; what may reach
the threshold is verified on the full sets.

Equal sets are one class from the start, so copies cost nothing further.  In a bucket, one
member is compared with all others: the one that meets most others over all bands, which
in a group of edited copies is the text they come from.  Where members of a bucket are
still in several components after that, these members are joined exactly, by the prefix and
position of their rarest shingles.  So every two members of a bucket are compared,
connected, or proven to overlap too little, without writing all pairs of a bucket.

Recall: with a base close to 1, registers agree with a probability of at least the overlap
J; a pair of J = 0.8 misses all 48 bands of 5 registers with a probability of
(1 - 0.8^5)^48 < 1e-8.  The estimate drops pairs more than five standard errors below.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .hashing import Poly, Words, mixed, slices

BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
#: Registers hold -log_BASE of their smallest point, between 0 and TOP.
BASE, SHIFT, TOP = 1.001, 20_000, 65_535

_WORD, _SHINGLE = Poly(11), Poly(12)


def _sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, sorted in each, and their number by text."""
    text = words.text_of()
    place = np.arange(len(text)) - words.first[text]
    count = words.counts[text]
    here = np.flatnonzero((place + size <= count) | ((place == 0) & (count < size)))
    hashes = _SHINGLE.ranges(words.hashes(_WORD), here, here + np.minimum(size, count[here]))
    owner = text[here]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(words.counts))


def registers_of(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The registers of each text (one row each); ``sets`` holds the texts' hashes one after the other.

    Points come in ascending order, so a shingle stops at the first one beyond the largest
    minimum its document can still need; where registers stay empty the bound is raised.
    """
    n = len(counts)
    low = np.full(n * REGISTERS, np.inf)
    owner = np.repeat(np.arange(n), counts)
    bound = np.where(counts > 0, (np.log(REGISTERS) + 3) / np.maximum(counts, 1), 0.0)
    # number of points so far and the last one of every shingle; points beyond the bound do no harm
    drawn, last = np.zeros(len(sets), np.uint64), np.zeros(len(sets))
    act = np.arange(len(sets))
    while True:
        while len(act):
            ahead = np.arange(min(64, max(1, 20_000 // len(act))), dtype=np.uint64)
            each = (sets[act] + drawn[act])[:, None] + ahead
            point = last[act][:, None] + np.cumsum(_gap(each), 1)
            slot = owner[act][:, None] * REGISTERS + (mixed(each, 21) % np.uint64(REGISTERS)).astype(np.int64)
            np.minimum.at(low, slot.ravel(), point.ravel())
            drawn[act] += np.uint64(len(ahead))
            last[act] = point[:, -1]
            act = act[last[act] <= bound[owner[act]]]
        # a document is done when all its registers are below its bound
        need = (low.reshape(n, REGISTERS).max(1) > bound) & (counts > 0)
        if not need.any():
            break
        bound = np.where(need, bound * 1.3, bound)
        act = np.flatnonzero((last <= bound[owner]) & need[owner])
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(low) / np.log(BASE)) + SHIFT
    return np.clip(np.where(np.isinf(low), 0, level), 0, TOP).astype(np.uint16).reshape(n, REGISTERS)


def _gap(each: np.ndarray) -> np.ndarray:
    """Exponential steps at a rate of one point per register."""
    uniform = ((mixed(each, 22) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(uniform) / REGISTERS


def overlap_estimate(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    """The overlap J of greatest likelihood, given how registers compare and how large the sets are."""
    more, less = (one > two).sum(1)[:, None], (one < two).sum(1)[:, None]
    u = (n_one / (n_one + n_two))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    # a register is larger in one set if the smaller minimum is of a shingle the other lacks
    first, second = np.clip(chance(u - v * grid), 1e-12, 1), np.clip(chance(v - u * grid), 1e-12, 1)
    same = np.clip(1 - first - second, 1e-12, 1)
    value = more * np.log(first) + less * np.log(second) + (one.shape[1] - more - less) * np.log(same)
    return grid[np.arange(len(one)), value.argmax(1)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).astype(np.uint64).view(np.int64))


def _blobs(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of a flat array as binary values."""
    offsets = np.concatenate([[0], np.cumsum(counts * flat.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for at, to, data, offsets in slices(batch):
            sets, counts = _sets(Words(data, offsets, lower=True), size)
            cuts = np.concatenate([[0], np.cumsum(counts)])
            prints = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(sets, s), dtype=np.uint64)]) for s in (31, 32)]
            own = ids.slice(at, to - at)
            # sets without words, or of rows without id, are equal to none but rows of their own id
            alone = (counts == 0) | np.asarray(own.is_null())
            numbers = np.asarray(own.fill_null(0)).astype(np.int64).view(np.uint64)
            one, two = [np.where(alone, mixed(numbers, 33), p[cuts[1:]] - p[cuts[:-1]]) for p in prints]
            registers = registers_of(sets, counts)
            yield pa.record_batch([own, pa.array(counts.astype(np.int64)), _signed(one), _signed(two),
                                   _blobs(registers.ravel(), np.full(to - at, REGISTERS))], names=["doc_id", "n", "one", "two", "registers"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document and band: a hash of the band's number and registers."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            registers = np.stack([np.frombuffer(r.as_buffer(), np.uint16) for r in part.column("registers")]).reshape(-1, ROWS)
            key = np.tile(np.arange(BANDS, dtype=np.uint64), part.num_rows)
            for column in registers.T:
                key = mixed(key ^ column.astype(np.uint64), 41)
            yield pa.record_batch([_signed(key), pa.array(np.repeat(np.asarray(part.column("doc_id")), BANDS))], names=["bucket", "doc_id"])


def _likely(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose registers do not rule out the threshold."""
    aim = percent / 100
    slack = 5 * np.sqrt(aim * (1 - aim) / REGISTERS)
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            one, two = (np.stack([np.frombuffer(r.as_buffer(), np.uint16) for r in part.column(c)]) for c in ("r_low", "r_high"))
            guess = overlap_estimate(one, two, np.asarray(part.column("n_low")), np.asarray(part.column("n_high")))
            yield part.select(["low", "high"]).filter(pa.array(guess >= aim - slack))


def _full_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, data, offsets in slices(batch):
            sets, counts = _sets(Words(data, offsets, lower=True), size)
            yield pa.record_batch([batch.column("doc_id").slice(at, to - at), _blobs(sets, counts)], names=["doc_id", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets overlap enough."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("s_low"), batch.column("s_high")):
            one, two = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            at = np.searchsorted(two, one)
            both = int((two[np.minimum(at, len(two) - 1)] == one).sum())
            keep.append(100 * both >= percent * (len(one) + len(two) - both))
        yield batch.select(["low", "high"]).filter(pa.array(keep, pa.bool_()))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (low, high): doc_id and label, the smallest id reachable.

    Alternates two steps, in which each node hands its larger, then its smaller neighbours
    to the smallest of them, until nothing changes; each step is a grouping with partial
    sums and a join that can be split.  Nodes without links have no row.
    """
    edges = stored(links.where("low <> high").select(
        F.greatest("low", "high").alias("node"), F.least("low", "high").alias("to")).distinct(), "links")
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = stored(both.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("least")), "links-least")
        # larger neighbours go to the smallest of the neighbourhood
        large = both.where("to > node").join(least, "node").select(F.col("to").alias("node"), F.col("least").alias("to"))
        large = stored(large.where("node <> to").distinct(), "links-large")
        # smaller neighbours too, and the node itself
        least = large.groupBy("node").agg(F.min("to").alias("least"))
        least = stored(least, "links-least")
        small = large.join(least, "node").select(F.col("to").alias("node"), F.col("least").alias("to"))
        edges = stored(small.unionAll(least.select("node", F.col("least").alias("to"))).where("node <> to").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "to").cast("decimal(20,0)"))).first()
        if now == state:
            return edges.groupBy(F.col("node").alias("doc_id")).agg(F.min("to").alias("label")).unionAll(
                edges.select(F.col("to").alias("doc_id"), F.col("to").alias("label")).distinct())
        state = now


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document and shingle."""
    for batch in batches:
        for i, blob in enumerate(batch.column("shingles")):
            hashes = np.frombuffer(blob.as_buffer(), np.int64)
            own = [pa.array(np.full(len(hashes), batch.column(c)[i].as_py(), np.int64)) for c in ("doc_id", "label")]
            yield pa.record_batch([*own, pa.array(np.full(len(hashes), len(hashes), np.int64)), pa.array(hashes)],
                                  names=["doc_id", "label", "n", "shingle"])


def _prefix_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs (low, high) of different labels that may reach the threshold: all that do, and few others.

    Every set is ordered by how rare its shingles are.  Two sets that overlap enough share
    a shingle among the first of both, and at the first one they share, what follows in
    the shorter rest still suffices; both are exact bounds.  Members that are one already
    need no pair: per shingle only those outside its most frequent label meet the others,
    so one stray member of a bucket of many copies costs a row per copy.
    """
    shingles = stored(rest.mapInArrow(_shingles, "doc_id long, label long, n long, shingle long").distinct(), "near-shingles")
    often = shingles.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    ordered = shingles.join(stored(often, "near-often"), "shingle", "left").withColumn(
        "place", F.expr("row_number() over (partition by doc_id, n order by coalesce(often, 1), shingle) - 1"))
    need = lambda n, parts: F.ceil(n * percent / F.lit(parts))
    first = stored(ordered.where(F.col("often").isNotNull() & (F.col("place") <= F.col("n") - need(F.col("n"), 100))), "near-prefixes")
    counted = first.groupBy("shingle", "label").agg(F.count("*").alias("rows")).groupBy("shingle").agg(
        F.max_by("label", F.struct("rows", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1").select("shingle", "most")
    counted = stored(counted, "near-most")
    strays = stored(first.join(counted, "shingle").where("label <> most").drop("most"), "near-strays")
    one, two = (x.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "label", "n", "place")]) for s, x in (("a", strays), ("b", first)))
    after = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    may = (F.col("label_a") != F.col("label_b")) & (
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (
        after >= need(F.col("n_a") + F.col("n_b"), 100 + percent))
    return one.join(two, "shingle").where(may).select(
        F.least("doc_id_a", "doc_id_b").alias("low"), F.greatest("doc_id_a", "doc_id_b").alias("high")).distinct()


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles (long), component_id (smallest doc_id reachable), kept (boolean).

    A document's set are its distinct shingles of ``size`` words, A-Z lower-cased; with
    fewer words, the whole sequence.  Documents with
    100 * intersection >= ``percent`` * union are linked.  Null and empty texts, and texts
    without words, have no shingles and no links.  Rows that share a doc_id are one node:
    each row has its own n_shingles, and links of any of them are links of all.  A row
    without doc_id has no links, component_id null, and is kept.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stored(rows.mapInArrow(partial(_sketch, size=size), "doc_id long, n long, one long, two long, registers binary"), "near-sketches")
    # equal sets are one class, led by its smallest id
    members = sketches.select("doc_id", "n", "one", "two")
    classes = stored(members.groupBy("one", "two", "n").agg(F.min("doc_id").alias("lead"), F.count("*").alias("rows")), "near-classes")
    shared = classes.where("rows > 1").select("one", "two", "n", "lead")
    named = members.join(shared.where("n > 0"), ["one", "two", "n"], "left").select("doc_id", "n", F.coalesce("lead", "doc_id").alias("lead"))
    named = stored(named, "near-named")
    # an id whose rows are in several classes makes them one component: each lead is linked to the smallest
    several = named.where("doc_id is not null").groupBy("doc_id").agg(F.min("lead").alias("low"), F.max("lead").alias("high")).where("low < high")
    same = named.join(several.select("doc_id", "low"), "doc_id").where("low < lead").select("low", F.col("lead").alias("high")).distinct()
    same = stored(same, "near-same")
    leads = classes.where("n > 0 and lead is not null").select(F.col("lead").alias("doc_id"), "one", "two")
    sketched = stored(sketches.join(leads, ["doc_id", "one", "two"]).dropDuplicates(["doc_id", "one", "two"]).select("doc_id", "n", "registers"), "near-leads")
    bands = sketched.mapInArrow(_bands, "bucket long, doc_id long")
    buckets = stored(bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "near-buckets")
    held = stored(bands.join(buckets, "bucket"), "near-held")
    meets = held.groupBy("doc_id").agg(F.sum("members").alias("meets"))
    leaders = held.join(meets, "doc_id").groupBy("bucket").agg(
        F.max(F.struct("meets", -F.col("doc_id"))).alias("most")).select("bucket", (-F.col("most.col2")).alias("lead"))
    held = stored(held.join(stored(leaders, "near-leaders"), "bucket").select("bucket", "doc_id", "lead"), "near-held")
    busy = held.select("doc_id").distinct()
    sets = stored(rows.join(busy, "doc_id").mapInArrow(partial(_full_sets, size=size), "doc_id long, shingles binary"), "near-sets")
    known = stored(sketched.join(busy, "doc_id"), "near-known")

    def verified(pairs: DataFrame) -> DataFrame:
        of = lambda side, c, r: known.select(F.col("doc_id").alias(side), F.col("n").alias(c), F.col("registers").alias(r))
        # sizes alone rule out pairs whose smaller set cannot cover enough of the larger
        sized = pairs.join(of("low", "n_low", "r_low"), "low").join(of("high", "n_high", "r_high"), "high").where(
            F.least("n_low", "n_high") * 100 >= F.greatest("n_low", "n_high") * percent)
        likely = stored(sized.mapInArrow(partial(_likely, percent=percent), "low long, high long").distinct(), "near-likely")
        full = lambda side, s: sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(s))
        return stored(likely.join(full("high", "s_high"), "high").join(full("low", "s_low"), "low").select("low", "high", "s_low", "s_high")
                      .mapInArrow(partial(_linked, percent=percent), "low long, high long").distinct(), "near-links")

    stars = held.where("doc_id <> lead").select(F.least("lead", "doc_id").alias("low"), F.greatest("lead", "doc_id").alias("high"))
    links = verified(stored(stars.distinct(), "near-pairs")).unionAll(same)
    labels = components(links)
    # members that their bucket's leader did not bring together
    at = held.where("doc_id <> lead").join(labels, "doc_id", "left").select("bucket", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    at = stored(at, "near-at")
    split = at.groupBy("bucket").agg(F.min("label").alias("one"), F.max("label").alias("two")).where("one < two").select("bucket")
    rest = stored(at.join(split, "bucket").select("doc_id", "label").distinct(), "near-rest")
    more = verified(stored(_prefix_pairs(rest.join(sets, "doc_id"), percent), "near-pairs"))
    if not more.isEmpty():
        labels = components(links.unionAll(more))
    found = labels.select(F.col("doc_id").alias("lead"), "label")
    return named.join(found, "lead", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "lead")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
