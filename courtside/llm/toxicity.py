"""Toxicity: embeddings of subwords, averaged into a linear softmax.

The character n-grams of words are hashed to rows of an embedding table; the mean of a
segment's rows goes through a linear softmax over two classes, and both are trained
together.  A misspelt word shares most of its n-grams with the known one, so it shares
their vectors.  A text is scored segment by segment, whole, and the most toxic segment
counts: a few toxic words are not thinned out by a long clean text.

For a trained model the mean of vectors through a linear layer is the mean of one number
per row, so scoring looks up one number per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import received, sent, text_key
from .hashing import Poly, mixed, slices

SIZES = (3, 4, 5)
ROWS_BITS, WIDTH = 16, 8
#: Words of a segment.
SEGMENT = 16
#: A text that scores as much is rejected.
REJECT = 0.7
#: Labelled rows that a model is trained on at most: toxic ones and others; they are read whole.
TRAIN_ROWS = (1500, 4500)

#: The logit of a segment without n-grams: nothing there is toxic.
NOTHING = -1e6

# a byte's class: letters and digits as they are, lower-cased, everything else a space
_PLAIN = np.full(256, 32, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _PLAIN[_b] = _b
for _b in range(65, 91):
    _PLAIN[_b] = _b + 32
_POWERS = Poly(79)
_WIDE = mixed(np.arange(256, dtype=np.uint64), 80)
_MIX = mixed(np.arange(256, dtype=np.uint64), 77).astype(np.uint32)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(places, table rows) of the n-grams of each size, segment of each byte, text of each segment.

    An n-gram may begin before and end after a word by the space that borders it.  Words of
    one text make segments of SEGMENT words; every text has at least one segment.  The row
    after the last stands for n-grams of words that their segment had before.
    """
    n, count = len(data), len(offsets) - 1
    plain = np.full(n + count + 1, 32, np.uint8)  # a space before every text and after the last
    lengths = np.diff(offsets)
    at = np.arange(n) + np.repeat(np.arange(1, count + 1), lengths)
    plain[at] = _PLAIN[data]
    space = plain == 32
    begins = ~space & np.concatenate([[True], space[:-1]])
    firsts = offsets + np.arange(count + 1)  # the space before each text
    word = np.cumsum(begins)
    before = word[firsts[:-1]]
    words = np.diff(np.concatenate([before, word[-1:]]))
    segments = np.maximum(1, -(-words // SEGMENT))
    start = np.concatenate([[0], np.cumsum(segments)])
    text = np.repeat(np.arange(count), np.diff(firsts))
    text = np.append(text, count - 1)
    # the space before a word belongs to it
    ahead = np.where(space & np.append(begins[1:], False), 1, 0)
    segment = start[text] + np.minimum(np.maximum(word + ahead - before[text] - 1, 0) // SEGMENT, segments[text] - 1)
    # a word that stands in its segment already adds nothing again, so repetition is no evidence
    codes = np.concatenate([[np.uint64(0)], np.cumsum(_WIDE[plain] * _POWERS.upto(len(plain)), dtype=np.uint64)])
    opens = np.flatnonzero(begins)
    closes = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    codes = mixed((codes[closes] - codes[opens]) * _POWERS.undone(len(plain))[opens], 78)
    seen = np.ones(word[-1] + 1, bool)
    if len(opens):
        order = np.lexsort((codes, segment[opens]))
        same = (codes[order][1:] == codes[order][:-1]) & (segment[opens][order][1:] == segment[opens][order][:-1])
        seen[order[1:][same] + 1] = False
    new = seen[np.minimum(word + ahead, word[-1])]
    gaps = np.cumsum(space)
    out, code = [], np.zeros(n + count + 1, np.uint32)
    for size in range(1, max(SIZES) + 1):
        m = len(plain) - size + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(0x01000193) + _MIX[plain[size - 1: size - 1 + m]]
        if size in SIZES:
            inside = gaps[size - 2: size - 2 + m] - gaps[:m] == 0 if size > 2 else np.ones(m, bool)
            places = np.flatnonzero(inside)
            mixed_ = code[places] ^ (code[places] >> np.uint32(15))
            rows = (mixed_ * np.uint32(0x9E3779B1)) >> np.uint32(32 - ROWS_BITS)
            out.append((places, np.where(new[places], rows, 1 << ROWS_BITS)))
    return out, segment, np.repeat(np.arange(count), segments)


def _segment_logits(found, segment: np.ndarray, n: int, value: np.ndarray) -> np.ndarray:
    total, many = np.zeros(n), np.zeros(n)
    for places, rows in found:
        where = segment[places]
        total += np.bincount(where, value[rows], n)
        many += np.bincount(where, minlength=n)
    return total / np.maximum(many, 1)


class Model:
    """Embeddings and softmax, and the line that turns a text's highest logit into a probability."""

    def __init__(self, value: np.ndarray, bias: float, slope: float, shift: float):
        self.value, self.bias, self.slope, self.shift = np.append(value, 0).astype(np.float32), bias, slope, shift

    def highest(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found, segment, text = grams(data, offsets)
        logits = _segment_logits(found, segment, len(text), self.value) + self.bias
        filled = np.zeros(len(text), bool)
        for places, _ in found:
            filled[segment[places]] = True
        logits = np.where(filled, logits, NOTHING)
        best = np.full(len(offsets) - 1, -np.inf)
        np.maximum.at(best, text, logits)
        return best

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.highest(data, offsets) + self.shift, -60, 60)))


def train(texts: list[str], labels: list[int], share: float = 0.3, epochs: int = 2, rate: float = 0.05, decay: float = 0.02, seed: int = 0) -> Model:
    """Embeddings and softmax by Adam over segments, then the line on the texts' highest logits.

    An epoch sees all segments.  A segment bears its text's label; from the second epoch on,
    only the most toxic quarter of a toxic text's segments does, so that clean passages of
    toxic texts do not mislead.  Rows that are seen decay, so n-grams without a bearing stay
    near zero.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels)
    if len(set(labels.tolist())) < 2:  # nothing to learn from one class: its share is the score
        share = float(np.clip(labels.mean() if len(labels) else 0.0, 0.01, 0.99))
        return Model(np.zeros(1 << ROWS_BITS), 0.0, 0.0, float(np.log(share / (1 - share))))
    pieces, of_doc = [], []
    for doc, text in enumerate(texts):
        words = text.split()
        cuts = np.arange(0, max(1, len(words)), SEGMENT)
        for at in cuts:
            pieces.append(" ".join(words[at: at + SEGMENT]).encode())
            of_doc.append(doc)
    # n-grams in the order of segments, made for a few pieces at a time
    parts, many, text = [], [], []
    for at, to, data, offsets in slices(pa.record_batch([pa.array(pieces, pa.binary()).cast(pa.string())], ["text"]), most=1 << 18):
        found, segment, piece = grams(data, offsets)
        owner = np.concatenate([segment[p] for p, _ in found])
        parts.append(np.concatenate([r for _, r in found])[np.argsort(owner, kind="stable")].astype(np.int32))
        many.append(np.bincount(owner, minlength=len(piece)))
        text.append(np.asarray(of_doc)[at:to][piece])
    rows, text = np.concatenate(parts), np.concatenate(text)
    starts = np.concatenate([[0], np.cumsum(np.concatenate(many))])
    del parts, pieces
    table = rng.normal(0, 0.1, ((1 << ROWS_BITS) + 1, WIDTH)).astype(np.float32)
    table[-1] = 0
    weight, bias = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    moments = [np.zeros_like(x) for x in (table, weight, bias) for _ in range(2)]
    step, toxic = 0, labels[text] == 1
    use = np.ones(len(text), bool)
    for epoch in range(epochs):
        if epoch:
            value = table @ (weight[:, 1] - weight[:, 0])
            logits = np.empty(len(text))
            for at in range(0, len(text), 4096):  # some segments at a time: all n-grams at once are large
                edges = starts[at: at + 4097]
                own = np.append(value[rows[edges[0]: edges[-1]]], np.float32(0))
                logits[at: at + 4096] = np.add.reduceat(own, edges[:-1] - edges[0]) * (np.diff(edges) > 0) / np.maximum(np.diff(edges), 1)
            use = ~toxic
            rank = np.lexsort((-logits, text))
            place = np.empty(len(text), np.int64)
            place[rank] = np.arange(len(text)) - np.searchsorted(text[rank], text[rank])
            use |= toxic & (place < np.maximum(1, np.bincount(text)[text] // 4))
        chosen = rng.permutation(np.flatnonzero(use))
        for batch in np.array_split(chosen, max(1, len(chosen) // 256)):
            step += 1
            many = (starts[batch + 1] - starts[batch])
            inside = np.repeat(starts[batch] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            mine, of = rows[inside], np.repeat(np.arange(len(batch)), many)
            mean = np.stack([np.bincount(of, table[mine, k], len(batch)) for k in range(WIDTH)], 1) / np.maximum(many, 1)[:, None]
            logit = mean @ weight + bias
            logit -= logit.max(1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), toxic[batch].astype(int)] -= 1
            p /= len(batch)
            back = ((p @ weight.T) / np.maximum(many, 1)[:, None]).astype(np.float32)
            touched, slot = np.unique(mine, return_inverse=True)
            grad = np.stack([np.bincount(slot, back[of, k], len(touched)) for k in range(WIDTH)], 1)
            for x, g, m, v, at in ((table, grad, moments[0], moments[1], touched), (weight, mean.T @ p, moments[2], moments[3], slice(None)),
                                   (bias, p.sum(0), moments[4], moments[5], slice(None))):
                m[at] = 0.9 * m[at] + 0.1 * g
                v[at] = 0.999 * v[at] + 0.001 * g * g
                if x is table:
                    g[touched == 1 << ROWS_BITS] = 0
                x[at] -= rate * decay * x[at] * (x is table) + rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.999**step)) + 1e-8)
    model = Model((table @ (weight[:, 1] - weight[:, 0]))[:-1], float(bias[1] - bias[0]), 1.0, 0.0)
    best = np.concatenate([model.highest(d, o) for _, _, d, o in slices(pa.record_batch([pa.array(texts)], ["text"]))])
    best, labels = best[best > NOTHING], labels[best > NOTHING]
    if len(set(labels.tolist())) < 2:
        return model
    spread = max(best.std(), 1e-6)
    slope, shift = 1.0, 0.0
    weigh = np.where(labels == 1, share / (labels == 1).sum(), (1 - share) / (labels == 0).sum())
    for _ in range(2000):  # logistic regression on one number, the classes weighed by their share
        p = 1 / (1 + np.exp(-(slope * best / spread + shift)))
        pull = (p - labels) * weigh
        slope, shift = slope - 4 * (pull * best / spread).sum(), shift - 4 * pull.sum()
    model.slope, model.shift = float(slope / spread), float(shift)
    return model


def remainder(doc_id: Column, by: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def fit(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = TRAIN_ROWS) -> Model:
    """Train on at most ``rows`` toxic and other documents, the first of ``docs`` by a hash of the id.

    ``labels`` has doc_id and toxic.  The rows are bounded and read whole, so one task trains
    on them; of an id that repeats the text with the smallest hash counts.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("toxic"))
    # only labels of documents that may be learned from count towards the bound
    known = known.join(docs.select("doc_id"), F.col("doc_id") == F.col("l_id"), "left_semi")
    order = F.md5(F.col("l_id").cast("string"))
    picked = known.where("toxic = 1").orderBy(order).limit(rows[0]).unionAll(known.where("toxic = 0").orderBy(order).limit(rows[1]))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "toxic")
    # of an id that repeats, each task sends on one row at most
    first = Window.partitionBy("doc_id").orderBy(text_key(F.col("text")))
    sample = sample.withColumn("__place", F.row_number().over(first)).where("__place = 1").drop("__place")

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["doc_id"])
        model = train([r["text"] or "" for r in got], [r["toxic"] for r in got])
        # numbers only: the class would bring its module's tables along
        yield pa.record_batch([pa.array([model.value.tobytes()], pa.binary()), *[pa.array([x]) for x in (model.bias, model.slope, model.shift)]],
                              names=["value", "bias", "slope", "shift"])

    got = sample.repartition(1).mapInArrow(trained, "value binary, bias double, slope double, shift double").first()
    if got is None:  # an empty sample may leave no task
        return train([], [])
    return Model(np.frombuffer(got["value"], np.float32)[:-1], got["bias"], got["slope"], got["shift"])


def score(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """The rows of ``docs`` with all their columns and ``column`` (double, 0 to 1).

    Null and empty texts, and texts without words, have nothing toxic and score 0 or nearly.  A column of ``docs`` by
    that name is replaced.
    """
    shared = sent(docs.sparkSession, model)
    rows = docs.drop(column)
    if "text" not in rows.columns:
        raise ValueError("docs needs a column text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(shared)
        for batch in batches:
            for at, to, data, offsets in slices(batch):
                yield batch.slice(at, to - at).append_column(column, pa.array(own.scores(data, offsets)))

    return rows.mapInArrow(scored, StructType([*rows.schema.fields, StructField(column, DoubleType())]))
