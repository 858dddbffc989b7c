"""Clustering of integer vectors around centroids, exact, with bounds that spare distances.

The distances of a vector to a few pivots are computed once.  They place it as the apex of
a simplex over the pivots (n-simplex projection; Connor, Vadicamo, Rabitti, "High-
dimensional simplexes for supermetric search", SISAP 2017): coordinates within the pivots'
span and a height above it.  The Euclidean distance of two apexes is a lower bound of the
true distance, the one with a height mirrored an upper bound.  A centroid whose lower bound
exceeds another's upper bound is out; those that are left are compared in exact integers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Pivots at most, and the first rows by hash among which they are searched.
PIVOTS, PIVOT_ROWS = 16, 64
#: Components up to here keep every squared distance of 64 to 1024 components within 63 bits.
PLAIN = 2.0**25
#: Rounding of apexes (kept as 32-bit floats) as a share of squared lengths, by far overstated.
SLACK = 1e-5
_LIMB = 60


class Clustering(NamedTuple):
    """vec_id, cluster (int), distance, cluster_inertia and inertia (longs) per row; the final centroids."""

    assigned: DataFrame
    centroids: list[list[int]]


class Simplex:
    """Pivots, the first of which is the origin, and the triangle that turns distances into coordinates."""

    def __init__(self, rows: np.ndarray):
        chosen: list[int] = []
        if len(rows):
            chosen, left = [0], ((rows - rows[0]) ** 2).sum(1)
            basis, widest = [], left.max()
            # the row farthest from the span of those before is next, so no triangle side is short
            while len(chosen) < PIVOTS and left.max() > 1e-4 * widest:
                chosen.append(int(left.argmax()))
                side = rows[chosen[-1]] - rows[0]
                side = side - sum(((side @ b) * b for b in basis), np.zeros(rows.shape[1]))
                basis.append(side / np.sqrt(side @ side))
                left = np.maximum(left - ((rows - rows[0]) @ basis[-1]) ** 2, 0)
        self.pivots = rows[chosen]
        sides = self.pivots[1:] - self.pivots[:1]
        self.squares = (sides**2).sum(1)
        self.triangle = np.linalg.cholesky(sides @ sides.T) if len(sides) else np.zeros((0, 0))

    def apexes(self, values: np.ndarray) -> np.ndarray:
        """Coordinates, then height, from the distances to the pivots."""
        if not len(self.pivots):
            return np.zeros((len(values), 0))
        far = np.stack([((values - p) ** 2).sum(1) for p in self.pivots], 1)
        flat = np.linalg.solve(self.triangle, ((far[:, :1] + self.squares - far[:, 1:]) / 2).T).T if len(self.squares) else far[:, 1:]
        height = np.sqrt(np.maximum(far[:, 0] - (flat**2).sum(1), 0))
        return np.concatenate([flat, height[:, None]], 1)


def candidates(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Which centroids (columns) the bounds leave for each vector (rows), given the apexes of both."""
    if not mine.shape[1]:
        return np.ones((len(mine), len(theirs)), bool)
    own, other = (mine**2).sum(1)[:, None], (theirs**2).sum(1)
    flat = own + other - 2 * mine[:, :-1] @ theirs[:, :-1].T
    both = 2 * mine[:, -1:] * theirs[:, -1]
    slack = SLACK * (own + other + 1)
    # the squares of the heights are in ``own`` and ``other``
    return flat - both - slack <= (flat + both + slack).min(1, keepdims=True)


def nearest(values: np.ndarray, mine: np.ndarray, centroids: list[list[int]], theirs: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each row, the smallest of equal ones."""
    centres = np.array(centroids, object)
    plain = np.abs(values).max(1) <= PLAIN if all(abs(x) <= PLAIN for c in centroids for x in c) else np.zeros(len(values), bool)
    label = np.zeros(len(values), np.int64)
    if plain.any():
        rows, fits = values[plain].astype(np.int64), candidates(mine[plain], theirs)
        open_ = fits.sum(1) > 1
        far = np.where(fits, 0, np.iinfo(np.int64).max)
        for c, centre in enumerate(centres.astype(np.int64)):
            here = np.flatnonzero(fits[:, c] & open_)
            far[here, c] = ((rows[here] - centre) ** 2).sum(1)
        label[plain] = far.argmin(1)
    for i in np.flatnonzero(~plain):
        label[i] = int(np.argmin([exact(values[i], c) for c in centroids]))
    return label


def exact(value: np.ndarray, centre: list[int]) -> int:
    return sum((int(x) - c) ** 2 for x, c in zip(value.tolist(), centre))


def _matrix(batch: pa.RecordBatch, column: str, kind: type) -> np.ndarray:
    held = batch.column(column)
    return np.asarray(held.flatten()).astype(kind).reshape(len(held), -1) if len(held) else np.zeros((0, 0), kind)


def _prepared(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """The integers of each vector, kept as doubles, which hold them exactly."""
    for batch in batches:
        with np.errstate(over="ignore"):
            values = np.floor(_matrix(batch, "embedding", np.float64) * scale)
        keep = np.isfinite(values).all(1) if len(values) else np.zeros(0, bool)
        yield pa.record_batch([batch.column("vec_id").filter(pa.array(keep)), _lists(values[keep])], names=["vec_id", "value"])


def _lists(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] if rows.ndim == 2 else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.reshape(-1)))


def _placed(batches: Iterator[pa.RecordBatch], simplex: Simplex) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        with np.errstate(over="ignore", invalid="ignore"):
            apexes = simplex.apexes(_matrix(batch, "value", np.float64)).astype(np.float32) if len(batch) else np.zeros((0, 0), np.float32)
        yield batch.append_column("apex", _lists(apexes))


def _labelled(batch: pa.RecordBatch, centroids: list[list[int]], theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = _matrix(batch, "value", np.float64)
    return values, nearest(values, _matrix(batch, "apex", np.float64), centroids, theirs)


def _sums(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], theirs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows and component sums of each cluster in this task; a sum is given in limbs of 60 bits, so that it never overflows."""
    total: dict[tuple[int, int], int] = defaultdict(int)
    for batch in batches:
        if not len(batch):
            continue
        values, label = _labelled(batch, centroids, theirs)
        plain = np.abs(values).max(1) <= PLAIN
        for c in np.unique(label).tolist():
            rows = values[(label == c) & plain].astype(np.int64)
            sums = rows.sum(0).tolist()
            for row in values[(label == c) & ~plain]:
                sums = [s + int(x) for s, x in zip(sums, row.tolist())]
            for k, s in enumerate([*sums, int((label == c).sum())]):
                total[c, k] += s
    out = []
    for (c, k), s in total.items():
        sign, rest, limb = (1 if s >= 0 else -1), abs(s), 0
        while rest or not limb:
            out.append((c, k, limb, sign * (rest & ((1 << _LIMB) - 1))))
            rest, limb = rest >> _LIMB, limb + 1
    yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                          names=["cluster", "place", "limb", "part"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], theirs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, label = _labelled(batch, centroids, theirs) if len(batch) else (np.zeros((0, 0)), np.zeros(0, np.int64))
        far: list[int | None] = [None] * len(label)
        for c, centre in enumerate(centroids):
            here = np.flatnonzero(label == c)
            fits = all(abs(x) <= PLAIN for x in centre)
            plain = here[np.abs(values[here]).max(1) <= PLAIN] if len(here) and fits else here[:0]
            for i, d in zip(plain.tolist(), ((values[plain].astype(np.int64) - np.array(centre if fits else [0], np.int64)) ** 2).sum(1).tolist()):
                far[i] = d
            for i in np.setdiff1d(here, plain).tolist():
                d = exact(values[i], centre)
                far[i] = d if d < 2**63 else None
        yield pa.record_batch([batch.column("vec_id"), pa.array(label.astype(np.int32)), pa.array(far, pa.int64())],
                              names=["vec_id", "cluster", "distance"])


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> Clustering:
    """Cluster the vectors (vec_id, embedding) that have ``dims`` components, none null or non-finite.

    A component x becomes the integer floor(scale * x).  Centroids start as the ``k`` kept
    vectors with the smallest sha256 of ``seed:vec_id`` (equal ids: smaller components
    first; rows without vec_id last).  Each round assigns all vectors to their nearest
    centroid, the smaller number on a tie, and moves each centroid that has any to the
    componentwise floor of their mean; then all are assigned once more.  With fewer than
    ``k`` vectors each is a centroid; an empty table has none.  A component whose
    ``scale``-fold exceeds the doubles counts as non-finite; distances and inertias beyond
    a long are null.  Repeated rows count each.
    """
    if not 1 <= dims <= 1024:
        raise ValueError("dims must be from 1 to 1024")
    finite = "size(embedding) = {} and forall(embedding, x -> x is not null and not isnan(x) and abs(x) <> double('infinity'))"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.expr(finite.format(dims)))
    rows = rows.mapInArrow(partial(_prepared, scale=scale), "vec_id long, value array<double>")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = [r["value"] for r in rows.orderBy(order.asc_nulls_last(), "value").limit(max(k, PIVOT_ROWS)).collect()]
    if not first:
        nothing = rows.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"))])
        return Clustering(nothing, [])
    centroids = [[int(x) for x in value] for value in first[:k]]
    plain = np.array([v for v in first if max(map(abs, v)) <= PLAIN], np.float64).reshape(-1, dims)
    simplex = Simplex(plain)
    # every round reads this table; the pivots' distances are not computed again
    placed = stored(rows.mapInArrow(partial(_placed, simplex=simplex), "vec_id long, value array<double>, apex array<float>"), "centroids-placed")
    for _ in range(rounds):
        theirs = simplex.apexes(np.array(centroids, np.float64))
        parts = placed.mapInArrow(partial(_sums, centroids=centroids, theirs=theirs), "cluster int, place int, limb int, part long")
        total: dict[int, list[int]] = {}
        for r in parts.groupBy("cluster", "place", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect():
            total.setdefault(r["cluster"], [0] * (dims + 1))[r["place"]] += int(r["part"]) << (_LIMB * r["limb"])
        centroids = [[s // total[c][dims] for s in total[c][:dims]] if c in total else old for c, old in enumerate(centroids)]
    theirs = simplex.apexes(np.array(centroids, np.float64))
    assigned = stored(placed.mapInArrow(partial(_assigned, centroids=centroids, theirs=theirs),
                                        "vec_id long, cluster int, distance long"), "centroids-assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("far"), (F.count("*") == F.count("distance")).alias("whole"))
    inertia: list[int | None] = [0] * len(centroids)
    for r in sums.collect():
        inertia[r["cluster"]] = int(r["far"]) if r["whole"] else None
    whole = None if None in inertia else sum(inertia)
    long = lambda x: F.lit(x if x is not None and x < 2**63 else None).cast("long")
    return Clustering(assigned.select("vec_id", "cluster", "distance",
                                      F.get(F.array(*[long(x) for x in inertia]), "cluster").alias("cluster_inertia"),
                                      long(whole).alias("inertia")), centroids)
