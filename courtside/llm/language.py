"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read whole, in pieces of PIECE bytes, each with MARGIN bytes of the text before and
after it.  Two recurrent layers go through a piece and its margins, one from each end, so that
their states are set when they come to the piece itself; at every byte a softmax over both
states labels that position.  The mean of the probabilities of all positions is the text's.
The network is trained here by backpropagation through time, on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_per_group, received, sent, text_key
from .hashing import slices

PIECE, MARGIN, HIDDEN = 128, 16, 8
SPAN = PIECE + 2 * MARGIN
#: Texts of each language that the network is trained on at most; they are read whole.
TRAIN_ROWS = 250
#: Pieces that go through the network together.
TOGETHER = 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Pieces:
    """The pieces of some texts: first byte, length and text of each; their bytes are laid out for a few at a time."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        lengths = np.diff(offsets)
        many = -(-lengths // PIECE)
        self.text = np.repeat(np.arange(len(lengths)), many)
        number = np.arange(len(self.text)) - np.repeat(np.cumsum(many) - many, many)
        self.first = offsets[:-1][self.text] + number * PIECE
        self.size = np.minimum(PIECE, offsets[1:][self.text] - self.first)

    def laid_out(self, which: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Bytes by position and piece with margins, spaces where the text has none; which places of the piece are filled."""
        first, size, text = self.first[which], self.size[which], self.text[which]
        at = first[None, :] + np.arange(-MARGIN, PIECE + MARGIN)[:, None]
        inside = (at >= self.offsets[:-1][text]) & (at < self.offsets[1:][text])
        return (np.where(inside, self.data[np.clip(at, 0, max(0, len(self.data) - 1))], 32).astype(np.uint8),
                np.arange(PIECE)[:, None] < size)


class Layer:
    """Gated recurrent units; rows of the weights are update gate, reset gate, candidate."""

    def __init__(self, rng: np.random.Generator):
        self.byte = rng.normal(0, 0.3, (3 * HIDDEN, 256)).astype(np.float32)
        self.back = rng.normal(0, 0.3, (3 * HIDDEN, HIDDEN)).astype(np.float32)

    def step(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        given, held = self.byte.take(x, 1), self.back @ state
        gates = _sigmoid(given[: 2 * HIDDEN] + held[: 2 * HIDDEN])
        update, reset = gates[:HIDDEN], gates[HIDDEN:]
        new = np.tanh(given[2 * HIDDEN:] + reset * held[2 * HIDDEN:])
        return state + update * (new - state), update, reset, new, held[2 * HIDDEN:]

    def states(self, x: np.ndarray, out: np.ndarray) -> None:
        """The states of the last ``len(out)`` steps, written to ``out``; the same numbers as by ``step``, without new arrays.

        The rows of both gates are halved beforehand, as a sigmoid is a tanh of half its argument.
        """
        half = np.repeat(np.float32([0.5, 0.5, 1]), HIDDEN)[:, None]
        byte, back = self.byte * half, self.back * half
        given, held = np.empty((2, 3 * HIDDEN, x.shape[1]), np.float32)
        gates, new, put = given[: 2 * HIDDEN], given[2 * HIDDEN:], held[2 * HIDDEN:]
        update, reset = gates[:HIDDEN], gates[HIDDEN:]
        margin, state = len(x) - len(out), np.zeros((HIDDEN, x.shape[1]), np.float32)
        for t in range(len(x)):
            np.take(byte, x[t], 1, out=given, mode="clip")
            np.matmul(back, state, out=held)
            gates += held[: 2 * HIDDEN]
            np.tanh(gates, out=gates)
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            put *= reset
            new += put
            np.tanh(new, out=new)
            new -= state
            new *= update
            state = np.add(state, new, out=state if t < margin else out[t - margin])

    def gradients(self, x: np.ndarray, pull: np.ndarray) -> list[np.ndarray]:
        """Of the loss by both weights, given how it pulls at the last ``len(pull)`` states; goes back through time."""
        kept, state = [], np.zeros((HIDDEN, x.shape[1]), np.float32)
        for t in range(len(x)):
            state_before, (state, *rest) = state, self.step(state, x[t])
            kept.append((state_before, *rest))
        on_back, at_input = np.zeros_like(self.back), np.empty((3 * HIDDEN, *x.shape), np.float32)
        margin, later = len(x) - len(pull), np.zeros((HIDDEN, x.shape[1]), np.float32)
        for t in range(len(x) - 1, -1, -1):
            before, update, reset, new, held = kept[t]
            if t >= margin:
                later = later + pull[t - margin]
            on_new = later * update * (1 - new * new)
            on_update = later * (new - before) * update * (1 - update)
            on_reset = on_new * held * reset * (1 - reset)
            at_input[:, t] = np.concatenate([on_update, on_reset, on_new])
            on_held = np.concatenate([on_update, on_reset, on_new * reset])
            on_back += on_held @ before.T
            later = later * (1 - update) + self.back.T @ on_held
        flat = x.ravel()
        return [np.stack([np.bincount(flat, row.ravel(), 256) for row in at_input]).astype(np.float32), on_back]


class Network:
    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages, self.ahead, self.behind = languages, Layer(rng), Layer(rng)
        self.out = rng.normal(0, 0.3, (len(languages), 2 * HIDDEN)).astype(np.float32)
        self.bias = np.zeros((len(languages), 1), np.float32)

    def _positions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and probabilities at every position of the pieces: (position, unit or language, piece).

        Each layer goes through the margin that it comes from, and ends with the piece.
        """
        both = np.empty((PIECE, 2 * HIDDEN, x.shape[1]), np.float32)
        self.ahead.states(x[:-MARGIN], both[:, :HIDDEN])
        self.behind.states(x[:MARGIN - 1:-1], both[::-1, HIDDEN:])
        logit = np.matmul(self.out, both) + self.bias
        logit -= logit.max(1, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(1, keepdims=True)
        return both, logit

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text the mean over all its positions; zeros for an empty text."""
        pieces = Pieces(data, offsets)
        sums = np.zeros((len(offsets) - 1, len(self.languages)))
        for at in range(0, len(pieces.text), TOGETHER):
            part = slice(at, at + TOGETHER)
            x, own = pieces.laid_out(part)
            total = np.where(own[:, None, :], self._positions(x)[1], 0).sum(0)
            for k in range(len(self.languages)):
                sums[:, k] += np.bincount(pieces.text[part], total[k], len(sums))
        return sums / np.maximum(np.diff(offsets), 1)[:, None]

    def fit(self, pieces: Pieces, label: np.ndarray, epochs: int = 3, rate: float = 0.02, seed: int = 0) -> None:
        """Go ``epochs`` times through all pieces; ``label`` has the language of each.

        Languages weigh the same whatever their bytes, so one very long text does not outvote the others.
        """
        rng = np.random.default_rng(seed)
        held = np.bincount(label, pieces.size, len(self.languages))
        weigh = (held.sum() / np.maximum(held, 1) / max(1, (held > 0).sum())).astype(np.float32)[label]
        weights = [self.ahead.byte, self.ahead.back, self.behind.byte, self.behind.back, self.out, self.bias]
        moments, step = [(np.zeros_like(w), np.zeros_like(w)) for w in weights], 0
        for _ in range(epochs):
            order = rng.permutation(len(label))
            for batch in np.array_split(order, max(1, len(order) // 256)):
                step += 1
                x, own = pieces.laid_out(batch)
                both, chance = self._positions(x)
                chance[:, label[batch], np.arange(len(batch))] -= 1
                chance *= own[:, None, :] * weigh[batch] / np.float32(own.sum())
                pull = np.matmul(self.out.T, chance)
                ahead = self.ahead.gradients(x[:-MARGIN], pull[:, :HIDDEN])
                behind = self.behind.gradients(x[:MARGIN - 1:-1], pull[::-1, HIDDEN:])
                last = [np.einsum("tlb,thb->lh", chance, both), chance.sum((0, 2))[:, None]]
                for w, g, (m, v) in zip(weights, (*ahead, *behind, *last), moments):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def numbers(self) -> bytes:
        """All weights, for another network of the same languages to take."""
        return b"".join(w.astype(np.float32).tobytes() for w in self._weights())

    def take(self, numbers: bytes) -> None:
        values, at = np.frombuffer(numbers, np.float32), 0
        for w in self._weights():
            w[...] = values[at: at + w.size].reshape(w.shape)
            at += w.size

    def _weights(self) -> list[np.ndarray]:
        return [self.ahead.byte, self.ahead.back, self.behind.byte, self.behind.back, self.out, self.bias]


def train(texts: list[str], languages: list[str], seed: int = 0) -> Network:
    """A network on all pieces of the texts."""
    names = sorted(set(languages))
    network = Network(names, seed)
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    pieces = Pieces(data, offsets)
    if len(names) > 1 and len(pieces.text):
        network.fit(pieces, np.array([names.index(k) for k in languages], int)[pieces.text])
    return network


def training_rows(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The first ``rows`` texts of each language by a hash of id and text, with a letter and a language.

    Hashes alone are ranked.  The chosen ones, at most ``rows`` for each output of the network, are
    broadcast as the network is, and no other text moves.  Equal rows count once.
    """
    named = docs.where("lang is not null and text rlike '\\\\p{L}'").select("doc_id", "lang", "text", text_key(F.col("text")).alias("text_key"))
    named = named.withColumn("row_key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_key")))
    chosen = first_per_group(named.select("lang", "row_key").distinct(), "lang", "row_key", rows)
    return named.join(F.broadcast(chosen), ["lang", "row_key"], "left_semi").dropDuplicates(["lang", "row_key"]).drop("row_key")


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Network:
    """Train on ``training_rows``: they move to one task, which reads them whole, holds their bytes, and sends back the weights."""
    sample = training_rows(docs, rows)

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["lang"], r["text_key"], r["doc_id"] or 0))
        network = train([r["text"] for r in got], [r["lang"] for r in got])
        yield pa.record_batch([pa.array([network.languages], pa.list_(pa.string())), pa.array([network.numbers()], pa.binary())], names=["languages", "numbers"])

    got = sample.repartition(1).mapInArrow(trained, "languages array<string>, numbers binary").first()
    network = Network(list(got["languages"]) if got else [])
    if got:
        network.take(got["numbers"])
    return network


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """Per row: doc_id, lang_pred, score (double, 0 to 1: the text's probability of that language).

    Texts that are null, empty or without a letter, and all texts of a network without
    languages, are ``und`` with score 0.  Equal probabilities go to the smaller name.
    Rows are judged each, whatever their id.
    """
    shared = sent(docs.sparkSession, network)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(shared)
        for batch in batches:
            for at, to, data, offsets in slices(batch):
                letters = np.asarray(batch.column("letters").slice(at, to - at)) & bool(own.languages)
                chance = own.probabilities(data, offsets) if own.languages else np.zeros((to - at, 1))
                best = chance.argmax(1)
                yield pa.record_batch([
                    batch.column("doc_id").slice(at, to - at),
                    pa.array([own.languages[k] if ok else "und" for k, ok in zip(best, letters)], pa.string()),
                    pa.array(np.where(letters, np.clip(chance.max(1), 0, 1), 0.0)),
                ], names=["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letters.alias("letters"))
    return rows.mapInArrow(named, "doc_id long, lang_pred string, score double")
