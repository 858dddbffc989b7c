"""Word positions and hashes of many texts at once, as numpy arrays over their bytes.

Hashes are polynomials over 64-bit numbers, so that the hash of any range is a difference of
two running sums; a second family with other constants makes 128 bits where equality is
decided by the hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Poly:
    """Hashes of ranges of a sequence of numbers, the same wherever the range stands."""

    def __init__(self, seed: int):
        self.base = int(mixed(np.array([seed * 7919 + 17], np.uint64))[0]) | 5
        self.inverse = pow(self.base, -1, 2**64)
        self.seed, self.powers, self.undo = seed, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.powers) < n:
            k = len(self.powers)
            for name, base in (("powers", self.base), ("undo", self.inverse)):
                have = getattr(self, name)
                setattr(self, name, np.concatenate([have, have * np.uint64(pow(base, k, 2**64))]))

    def upto(self, n: int) -> np.ndarray:
        self._grow(n)
        return self.powers[:n]

    def undone(self, n: int) -> np.ndarray:
        self._grow(n)
        return self.undo[:n]

    def ranges(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers[: len(values)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.undo[starts] + (ends - starts).astype(np.uint64), self.seed)


class Words:
    """The words of some texts: those of text i are ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = _LOWER[data]
        sep, n = _SEP[data], len(data)
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        edge = np.ones(n + 1, bool)  # a separator or a text's border before the byte
        edge[1:n] = sep[:-1]
        self.starts = np.flatnonzero(~sep & (edge | begins)[:n])
        after = np.ones(n, bool)
        after[: n - 1] = sep[1:]
        self.ends = np.flatnonzero(~sep & (after | begins[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.data = data

    def hashes(self, poly: Poly) -> np.ndarray:
        return poly.ranges(_table(poly.seed)[self.data], self.starts, self.ends)

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


_TABLES: dict[int, np.ndarray] = {}


def _table(seed: int) -> np.ndarray:
    if seed not in _TABLES:
        _TABLES[seed] = mixed(np.arange(256, dtype=np.uint64), seed + 1000)
    return _TABLES[seed]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, rows to, UTF-8 bytes and offsets, of about ``most`` bytes or one row; null is empty.

    The bytes are those of the batch, so a batch costs no Python object per text.
    """
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, len(texts))
        yield at, to, data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at]
        at = to
