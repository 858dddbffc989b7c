"""Removal of word sequences that already stand in a document with a smaller id.

All windows of 50 words would be as many rows as words.  Instead, windows of 20 words are
hashed only at positions that are, modulo 31, in a difference cover: for any two positions
there is a step of less than 31 words after which both are in the cover.  So two documents
that share 50 words share a hashed window of 20 words that both have sampled (20 + 31 - 1 =
50), and documents without a shared anchor are done.  Around shared anchors the matches are
extended: all windows of 50 words that hold one are hashed with 96 bits, and the smallest
document of each is found.  Every step groups by a hash with partial sums; no pairs are
formed, however many documents share a passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .hashing import Poly, Words, slices

#: A difference cover: every difference modulo the period is one of two members.
COVER, PERIOD = (0, 1, 3, 8, 12, 18), 31

_WORD_A, _WORD_B, _ANCHOR, _WIDE_A, _WIDE_B = (Poly(s) for s in (1, 2, 3, 4, 5))


def _column(values, kind=pa.int64()) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if kind == pa.int64() else values, kind)


def _anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Hash, document and position of the windows at cover positions."""
    size, cover = window - PERIOD + 1, np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for at, to, data, offsets in slices(batch):
            words = Words(data, offsets)
            text = words.text_of()
            place = np.arange(len(text)) - words.first[text]
            here = np.flatnonzero(cover[place % PERIOD] & (place + size <= words.counts[text]) & (words.counts[text] >= window))
            hashes = _ANCHOR.ranges(words.hashes(_WORD_A), here, here + size)
            yield pa.record_batch([_column(hashes), _column(ids[at:to][text[here]]), pa.array(place[here].astype(np.int32))],
                                  names=["h", "doc_id", "place"])


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit hash of the word sequence of each text."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for at, to, data, offsets in slices(batch):
            words = Words(data, offsets)
            one = _WIDE_A.ranges(words.hashes(_WORD_A), words.first[:-1], words.first[1:])
            two = _WIDE_B.ranges(words.hashes(_WORD_B), words.first[:-1], words.first[1:])
            yield pa.record_batch([_column(ids[at:to]), _column(one), _column(two), _column(words.counts.astype(np.int64))],
                                  names=["doc_id", "one", "two", "n"])


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """A hash of 96 bits, document and position of all windows that hold a shared anchor."""
    size = window - PERIOD + 1
    for batch in batches:
        ids, places = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("places")
        for at, to, data, offsets in slices(batch):
            words = Words(data, offsets)
            opened = np.zeros(len(words.starts) + 1, np.int32)
            held = places.slice(at, to - at)
            shared = np.asarray(held.flatten()) + np.repeat(words.first[:-1], np.asarray(held.value_lengths()))
            row = np.repeat(np.arange(to - at), np.asarray(held.value_lengths()))
            np.add.at(opened, np.maximum(shared - (window - size), words.first[row]), 1)
            np.add.at(opened, np.minimum(shared + 1, words.first[row + 1]), -1)
            text = words.text_of()
            place = np.arange(len(text)) - words.first[text]
            here = np.flatnonzero((np.cumsum(opened)[:-1] > 0) & (place + window <= words.counts[text]))
            one = _WIDE_A.ranges(words.hashes(_WORD_A), here, here + window)
            two = _WIDE_B.ranges(words.hashes(_WORD_B), here, here + window).astype(np.uint32).view(np.int32)
            yield pa.record_batch([_column(one), pa.array(two), _column(ids[at:to][text[here]]), pa.array(place[here].astype(np.int32))],
                                  names=["one", "two", "doc_id", "place"])


def _rest(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """What is left of each text without the words that the windows at ``places`` cover."""
    for batch in batches:
        texts, copy = batch.column("text"), np.asarray(batch.column("copy").to_numpy(zero_copy_only=False))
        out = []
        for i, places in enumerate(batch.column("places")):
            words = (texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b"").split()
            n, gone = len(words), 0
            if copy[i] and n >= window:
                words, gone = [], n
            elif places.is_valid and len(places):
                cover = np.zeros(n + 1, np.int32)
                starts = np.asarray(places.values)
                np.add.at(cover, starts, 1)
                np.add.at(cover, np.minimum(starts + window, n), -1)
                held = np.cumsum(cover)[:n] > 0
                words, gone = [w for w, x in zip(words, held) if not x], int(held.sum())
            out.append((n, gone, b" ".join(words)))
        rest = pa.array([x[2] for x in out], pa.binary()).cast(pa.string())
        yield pa.record_batch([batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                               pa.array([hashlib.sha256(x[2]).hexdigest() for x in out]), rest],
                              names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per row: doc_id, n_words, n_removed (longs), kept_sha256 and kept_text (kept words, one space between).

    A word goes if a window of ``window`` words (31 to 50 beyond the period: at least 32)
    that covers it has its word sequence also in a document with a smaller doc_id; windows
    are those of the input.  Null and empty texts have no words.  Rows that share a doc_id
    never remove each other's words, but a window of one that is found elsewhere marks its
    place in all of them: they should be equal.  Rows without doc_id keep all their words
    and take none from others.
    """
    if window <= PERIOD:
        raise ValueError(f"window must exceed {PERIOD} words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # a written table ends each step, and with it the disk that its shuffles take
    named = rows.where("doc_id is not null")
    anchors = named.mapInArrow(partial(_anchors, window=window), "h long, doc_id long, place int")
    shared = anchors.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    # what recurs is written before the rows look it up: a join of plain shuffles can be split where one hash is hot
    marked = anchors.join(stored(shared.select("h"), "repeats-anchors"), "h").select("doc_id", "place", F.lit(False).alias("copy"))
    # a whole copy of a smaller document loses every word and has nothing to add
    wholes = named.mapInArrow(_wholes, "doc_id long, one long, two long, n long").where(F.col("n") >= window)
    first = wholes.groupBy("one", "two", "n").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    copied = wholes.join(stored(first, "repeats-wholes"), ["one", "two", "n"]).where("doc_id > low").select("doc_id", F.lit(None).cast("int").alias("place"), F.lit(True).alias("copy"))
    copied = stored(copied, "repeats-copies")
    marks = stored(marked.unionAll(copied).groupBy("doc_id").agg(
        F.collect_list("place").alias("places"), F.max("copy").alias("copy")).where("not copy"), "repeats-marks")
    found = rows.join(marks, "doc_id").select("doc_id", "text", "places")
    windows = found.mapInArrow(partial(_windows, window=window), "one long, two int, doc_id long, place int")
    source = windows.groupBy("one", "two").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    source = stored(source.drop("high"), "repeats-windows")
    again = windows.join(source, ["one", "two"]).where("doc_id > low").select("doc_id", "place", F.lit(False).alias("copy"))
    gone = stored(again.unionAll(copied).groupBy("doc_id").agg(
        F.collect_list("place").alias("places"), F.max("copy").alias("copy")), "repeats-gone")
    left = rows.join(gone, "doc_id", "left").select("doc_id", "text", "places", F.coalesce("copy", F.lit(False)).alias("copy"))
    return left.mapInArrow(partial(_rest, window=window),
                           "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
