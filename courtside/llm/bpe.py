"""Byte-level BPE: texts to token ids and back.

A text is split by a pattern; each piece starts as single bytes and the pair of neighbours
with the lowest rank, the leftmost of equal ones, is merged until none has a rank.  A
segment tree over the piece's byte positions holds, per node, the smallest rank and place
below it: the root is the next merge, and a merge changes three leaves (the merged pair, the
pair before it and the token that went), so a piece of n bytes takes O(n log n) steps
however its merges fall.  Short pieces that are new to a task go through their trees side
by side, as rows of one array; a longer piece has a tree of its own.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import received, sent

#: Characters that are split at a time, pieces that a task remembers, bytes of a piece that is remembered (and
#: merged with others in one array), pieces of one array, and ids or bytes that an output batch gathers.
STRETCH, REMEMBERED, SHORT, TOGETHER, BATCH = 1 << 20, 1 << 19, 64, 1 << 12, 1 << 20
#: Characters after a match that may decide where it ends.
AHEAD = 8
_NONE = (1 << 63) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a file of lines ``base64 rank``; its size bounds what is broadcast."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every byte needs a rank")
    return ranks


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece of one byte or more."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    tree = array("q", [_NONE]) * (2 * width)
    ends, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    for i in range(n - 1):
        rank = ranks.get(piece[i:i + 2])
        if rank is not None:
            tree[width + i] = rank * n + i  # the smallest is the lowest rank, then the leftmost place
    for i in range(width - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left < right else right

    def put(place: int, rank: int | None) -> None:
        at = width + place
        tree[at] = _NONE if rank is None else rank * n + place
        at >>= 1
        while at:
            left, right = tree[2 * at], tree[2 * at + 1]
            least = left if left < right else right
            if tree[at] == least:
                break
            tree[at] = least
            at >>= 1

    while tree[1] != _NONE:
        i = tree[1] % n
        gone = ends[i]
        end = ends[i] = ends[gone]
        put(gone, None)
        if end < n:
            before[end] = i
        put(i, ranks.get(piece[i:ends[end]]) if end < n else None)
        if before[i] >= 0:
            put(before[i], ranks.get(piece[before[i]:end]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:ends[i]]])
        i = ends[i]
    return out


class Pairs:
    """The rank of two neighbouring tokens, for arrays of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.most = max(ranks.values()) + 1
        found = sorted((ranks[t[:i]] * self.most + ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t))
                       if t[:i] in ranks and t[i:] in ranks)
        self.keys, self.ranks = (np.array([x[k] for x in found] + [_NONE], np.int64) for k in (0, 1))
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """rank * width + place, or _NONE; a negative id has no neighbour."""
        key = left * self.most + right
        at = np.searchsorted(self.keys, key)
        has = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(has, self.ranks[at] * width + place, _NONE)


def merged_together(pieces: list[bytes], pairs: Pairs) -> Iterator[bytes]:
    """As ``merged`` for many short pieces: a row with a tree for each, merged once per turn; ids as 32-bit integers."""
    sizes = np.array([len(p) for p in pieces])
    count, width = len(pieces), 1 << int(max(sizes.max() - 1, 1)).bit_length()
    token = np.full((count, width + 1), -1, np.int64)
    row = np.repeat(np.arange(count), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    token[row, place] = pairs.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.minimum(np.arange(1, width + 2), width) + np.zeros((count, 1), np.int64)
    before = np.arange(-1, width) + np.zeros((count, 1), np.int64)
    tree = np.full((count, 2 * width), _NONE, np.int64)
    tree[:, width:] = pairs.of(token[:, :-1], token[:, 1:], np.arange(width), width)
    at = width
    while at > 1:
        at //= 2
        tree[:, at:2 * at] = np.minimum(tree[:, 2 * at:4 * at:2], tree[:, 2 * at + 1:4 * at:2])
    live = np.flatnonzero(tree[:, 1] != _NONE)
    while len(live):
        rank, i = np.divmod(tree[live, 1], width)
        gone = after[live, i]
        end = after[live, gone]
        token[live, i], token[live, gone] = rank, -1
        after[live, i], before[live, end] = end, i
        first = before[live, i]
        head = np.maximum(first, 0)  # without a token before, the pair there is the merged one
        tree[live, width + gone] = _NONE
        tree[live, width + i] = pairs.of(rank, token[live, end], i, width)
        changed = pairs.of(token[live, head], rank, head, width)
        tree[live, width + head] = np.where(first >= 0, changed, tree[live, width + head])
        for leaf in (gone, i, head):
            at = (width + leaf) >> 1
            while at[0]:
                tree[live, at] = np.minimum(tree[live, 2 * at], tree[live, 2 * at + 1])
                at = at >> 1
        live = live[tree[live, 1] != _NONE]
    left = token >= 0
    flat = token[left].astype("<i4").tobytes()
    ends = (4 * np.cumsum(left.sum(1))).tolist()
    return (flat[i:j] for i, j in zip([0, *ends], ends))


class Remembered(dict):
    """The ids of pieces as little-endian 32-bit integers; the short ones are kept, up to a number."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.pairs = ranks, Pairs(ranks)

    def __missing__(self, piece: str) -> bytes:
        return np.array(merged(piece.encode(), self.ranks), "<i4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Find the ids of the short pieces that are not known yet."""
        new = pieces.difference(self.keys())
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = pieces
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            held = piece.encode()
            whole = self.ranks.get(held)
            if whole is not None:
                self[piece] = whole.to_bytes(4, "little")
            elif len(held) <= SHORT:
                by_size.setdefault((len(held) - 1).bit_length(), []).append((piece, held))
        for some in by_size.values():
            for at in range(0, len(some), TOGETHER):
                part = some[at:at + TOGETHER]
                for (piece, _), ids in zip(part, merged_together([held for _, held in part], self.pairs)):
                    self[piece] = ids


def stretches(text: str, pattern: regex.Pattern, most: int = STRETCH) -> Iterator[list[str]]:
    """The matches of the whole text, some at a time; they leave no character out.

    A match is final unless it ends within AHEAD characters of a stretch's end; the next
    stretch begins with the first that is not.  So the pattern must not look farther ahead.
    """
    at, take = 0, most
    while at < len(text):
        end = min(len(text), at + take)
        found = pattern.findall(text, at, end)
        if end == len(text):
            yield found
            return
        last = end
        while found and last > end - AHEAD:
            last -= len(found.pop())
        if found:
            yield found
            at, take = last, most
        else:  # a match longer than the stretch
            take *= 2


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.known = regex.compile(pattern), Remembered(ranks)

    def ids(self, texts: Iterator[str]) -> Iterator[bytes]:
        """The ids of each text, as 32-bit integers; pieces of some texts are looked up together."""
        waiting: list[list[str]] = []
        parts: list[list[bytes]] = []
        held, done = 0, []

        def look_up() -> None:
            self.known.learn(set().union(*waiting))
            get = self.known.__getitem__
            for to, found in zip(done, waiting):
                to.append(b"".join(map(get, found)))
            waiting.clear()
            done.clear()

        for text in texts:
            parts.append([])
            for found in stretches(text, self.pattern):
                waiting.append(found)
                done.append(parts[-1])
                held += STRETCH if len(text) > STRETCH else len(text)
                if held >= STRETCH:
                    look_up()
                    held = 0
            if not held:
                yield from map(b"".join, parts)
                parts = []
        look_up()
        yield from map(b"".join, parts)


def _whole(docs: DataFrame, column: str, added: str) -> DataFrame:
    if column not in docs.columns:
        raise ValueError(f"a column {column} is needed")
    return docs.drop(added)


def _gathered(batch: pa.RecordBatch, made: Iterator[bytes], width: int, build) -> Iterator[pa.RecordBatch]:
    """Rows of ``batch`` with what is made of each, in batches of bounded size."""
    start, held, total = 0, [], 0
    for i, piece in enumerate(made):
        held.append(piece)
        total += len(piece) // width
        if total >= BATCH or i + 1 == len(batch):
            yield pa.RecordBatch.from_arrays([*batch.slice(start, len(held)).columns, build(held)], names=[*batch.schema.names, "__added"])
            start, held, total = i + 1, [], 0


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", added: str = "ids") -> DataFrame:
    """The rows of ``docs`` with all columns and the token ids of ``column`` (array of int).

    ``path`` names the file of ranks, read on the driver; ``pattern`` splits the text, and what
    it matches must not depend on more than AHEAD characters after the match.  Whole
    texts are encoded, without special tokens: their strings are ordinary text.  Null and
    empty texts have no ids; bytes that are not UTF-8 are read as U+FFFD.  A column named as
    ``added`` is replaced.  A task holds one text, its ids, and about 32 bytes for each
    byte of the longest piece.
    """
    rows = _whole(docs, column, added)
    shared = sent(docs.sparkSession, (read_ranks(path), pattern))
    schema = StructType([*rows.schema.fields, StructField(added, ArrayType(IntegerType()))])
    place = rows.columns.index(column)

    def lists(held: list[bytes]) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in held])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(held), "<i4")))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*received(shared))
        for batch in batches:
            texts = batch.column(place).cast(pa.binary())
            read = (t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else "" for t in texts)
            for out in _gathered(batch, encoder.ids(read), 4, lists):
                yield out.rename_columns([*batch.schema.names, added])

    return rows.mapInArrow(encoded, schema)


def decode(rows: DataFrame, path: str, column: str = "ids", added: str = "decoded") -> DataFrame:
    """The rows with all columns and the bytes (binary) that the token ids in ``column`` stand for.

    Null and empty lists give no bytes; an id without a token is an error.
    """
    rows = _whole(rows, column, added)
    shared = sent(rows.sparkSession, {rank: token for token, rank in read_ranks(path).items()})
    schema = StructType([*rows.schema.fields, StructField(added, BinaryType())])
    place = rows.columns.index(column)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = received(shared).__getitem__
        for batch in batches:
            made = (b"".join(map(token, np.asarray(ids.values).tolist())) if ids.is_valid else b"" for ids in batch.column(place))
            for out in _gathered(batch, made, 1, lambda held: pa.array(held, pa.binary())):
                yield out.rename_columns([*batch.schema.names, added])

    return rows.mapInArrow(decoded, schema)
