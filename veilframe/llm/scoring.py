"""Masked pseudo-likelihood of documents under a bidirectional window network over bytes.

A byte is predicted from the ``SIDE`` bytes on either side of it; positions outside the text are a symbol of their own. The
network (embeddings, one hidden layer, softmax over 256 bytes) is trained in numpy on the window counts of the whole
corpus: tasks train on their share of the distinct windows, and the parameters are averaged between rounds. A document's
score is the sum of the conditional log-probabilities of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import U64, free_name, give_back, lean, mix, pieces, random_words, utf8
from veilframe.session import cut_lineage

SIDE = 2
EDGE = 256
WIDTH = 12
HIDDEN = 48
ROUNDS = 3
_CHUNK = 1 << 20
_BITS = 9
_MOST_WINDOWS = 2_000_000


def windows(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The window around every byte as one word: the bytes to the left, itself, those to the right, 9 bits each."""
    n, rows = len(data), len(bounds) - 1
    row = np.repeat(np.arange(rows), np.diff(bounds))
    padded = np.full(n + 2 * SIDE * rows + 2 * SIDE, EDGE, np.uint16)
    place = np.arange(n) + (row + 1) * 2 * SIDE  # texts lie at least twice SIDE edge symbols apart
    padded[place] = data
    out = np.zeros(n, U64)
    for i in range(-SIDE, SIDE + 1):
        out = out << U64(_BITS) | padded[place + i].astype(U64)
    return out


def _symbols(codes: np.ndarray) -> np.ndarray:
    shifts = U64(_BITS) * np.arange(2 * SIDE, -1, -1, dtype=U64)
    return (codes[:, None] >> shifts & U64((1 << _BITS) - 1)).astype(np.int64)


def window_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``code`` and ``n`` of every distinct window of the corpus; counted within tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, U64), np.zeros(0, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(codes), 1 << 17):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes[a:a + (1 << 17)].view(np.int64)), pa.array(counts[a:a + (1 << 17)])], ["code", "n"])

        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            for a, b in pieces(bounds, _CHUNK):
                new, times = np.unique(windows(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a]), return_counts=True)
                both = np.concatenate([codes, new])
                order = np.argsort(both, kind="stable")
                heads = np.flatnonzero(np.r_[True, both[order][1:] != both[order][:-1]]) if len(both) else np.zeros(0, np.int64)
                counts = np.add.reduceat(np.concatenate([counts, times])[order], heads) if len(heads) else counts
                codes = both[order][heads]
                if len(codes) > _MOST_WINDOWS:
                    yield from out()
                    codes, counts = codes[:0], counts[:0]
        yield from out()

    text = docs.select(F.col(text_col).cast("string").alias("text")).where("text <> ''")
    return text.mapInArrow(lean(count), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Network:
    """Parameters in one vector: embeddings, hidden layer and bias, output layer and bias."""

    flat: np.ndarray

    @staticmethod
    def shapes() -> list[tuple[int, ...]]:
        return [(EDGE + 1, WIDTH), (2 * SIDE * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, 256), (256,)]

    @classmethod
    def start(cls, seed: int = 1) -> Network:
        parts = []
        for i, shape in enumerate(cls.shapes()):
            noise = random_words(seed * 10 + i, int(np.prod(shape))).astype(np.float64) / 2.0 ** 64 - 0.5
            parts.append(noise * (2 / np.sqrt(shape[0])) if len(shape) > 1 and i else noise if i == 0 else noise * 0)
        return cls(np.concatenate(parts).astype(np.float32))

    def layers(self) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self.shapes():
            n = int(np.prod(shape))
            out.append(self.flat[at:at + n].reshape(shape))
            at += n
        return out

    def _forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        embedding, w1, b1, w2, b2 = self.layers()
        x = embedding[around].reshape(len(around), -1)
        hidden = np.maximum(x @ w1 + b1, 0)
        logits = hidden @ w2 + b2
        logits -= logits.max(axis=1, keepdims=True)
        return x, hidden, logits

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """The log-probability of the middle byte of each window."""
        symbols = _symbols(codes)
        _, _, logits = self._forward(np.delete(symbols, SIDE, axis=1))
        own = logits[np.arange(len(codes)), symbols[:, SIDE]]
        return own - np.log(np.exp(logits).sum(axis=1))

    def gradient(self, symbols: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of the weighted mean of the negative log-probabilities."""
        embedding, w1, _, w2, _ = self.layers()
        around = np.delete(symbols, SIDE, axis=1)
        x, hidden, logits = self._forward(around)
        error = np.exp(logits)
        error /= error.sum(axis=1, keepdims=True)
        error[np.arange(len(symbols)), symbols[:, SIDE]] -= 1
        error *= (weight / weight.sum()).astype(np.float32)[:, None]
        back = (error @ w2.T) * (hidden > 0)
        to_x = (back @ w1.T).reshape(-1, WIDTH)
        to_embedding = np.stack([np.bincount(around.ravel(), to_x[:, i], minlength=EDGE + 1) for i in range(WIDTH)], axis=1)
        return np.concatenate([to_embedding.ravel(), (x.T @ back).ravel(), back.sum(axis=0), (hidden.T @ error).ravel(),
                               error.sum(axis=0)]).astype(np.float32)


SHARD_WINDOWS = 1 << 18  # distinct windows that one task trains on, about


def _learner(start: Network, step_size: float, batch: int):
    """Adam over a shard, from ``start``: parameters times the shard's weight, and that weight."""
    size = len(start.flat)

    def learn(rows: pa.Table) -> pa.Table:
        codes = rows.column("code").to_numpy().view(U64)
        order = np.argsort(mix(codes))
        codes, weight = codes[order], rows.column("n").to_numpy()[order].astype(np.float64)
        current, first, second = start.flat.copy(), np.zeros(size, np.float32), np.zeros(size, np.float32)
        for step, a in enumerate(range(0, len(codes), batch), 1):
            gradient = Network(current).gradient(_symbols(codes[a:a + batch]), weight[a:a + batch])
            first = 0.9 * first + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient * gradient
            current = current - step_size * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-6)
        total = weight.sum()
        give_back()
        return pa.table({"i": np.arange(size), "v": (current * total).astype(np.float64), "w": np.full(size, total)})

    return learn


def train(counts: DataFrame, rounds: int = ROUNDS, rate: float = 0.01, batch: int = 2048) -> Network:
    """Rounds of local Adam over every distinct window, weighted by its count, and averaging by the windows' weight.

    Windows are dealt by hash into shards, whose number follows from how many there are, and taken in order of a hash inside a
    shard: the network depends on the corpus, not on how it is laid out. ``counts`` should be a written table. The driver gets
    one number per parameter and round, whatever the corpus.
    """
    network = Network.start()
    size = len(network.flat)
    shards = -(-counts.count() // SHARD_WINDOWS) or 1
    dealt = counts.select("code", "n", F.pmod(F.xxhash64("code"), F.lit(shards)).alias("shard"))
    for turn in range(rounds):
        rows = dealt.groupBy("shard").applyInArrow(_learner(network, rate / (1 + turn), batch), "i bigint, v double, w double").groupBy("i").agg(
            F.sum("v").alias("v"), F.sum("w").alias("w")).collect()
        if not rows:
            return network
        flat = np.zeros(size)
        for r in rows:
            flat[r["i"]] = r["v"] / r["w"]
        network = Network(flat.astype(np.float32))
    return network


def score_of(text: Column, network: Network) -> Column:
    """A struct of ``n_tokens`` (bytes), ``log_likelihood`` (their sum) and ``per_token`` (its mean; 0 without bytes).

    Null and empty texts have no tokens and likelihood 0. Every byte of a text counts, however long it is.
    """

    @F.arrow_udf("struct<n_tokens:bigint,log_likelihood:double,per_token:double>")
    def score(texts: pa.Array) -> pa.Array:
        data, bounds = utf8(texts)
        sums = np.zeros(len(bounds) - 1)
        for a, b in pieces(bounds, _CHUNK):
            part = bounds[a:b + 1] - bounds[a]
            codes = windows(data[bounds[a]:bounds[b]], part)
            if not len(codes):
                continue
            order = np.argsort(codes)
            head = np.r_[True, codes[order][1:] != codes[order][:-1]]
            distinct = codes[order[head]]
            which = np.empty(len(codes), np.int64)
            which[order] = np.cumsum(head) - 1
            total = np.r_[0.0, np.cumsum(_known(network, distinct)[which])]
            sums[a:b] = total[part[1:]] - total[part[:-1]]
        n = np.diff(bounds)
        return pa.StructArray.from_arrays(
            [pa.array(n), pa.array(sums), pa.array(sums / np.maximum(n, 1))], ["n_tokens", "log_likelihood", "per_token"])

    return score(text.cast("string"))


_seen: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _known(network: Network, distinct: np.ndarray) -> np.ndarray:
    """Log-probabilities of sorted distinct windows; a task remembers those it has computed, up to a bound."""
    key = network.flat[:64].tobytes() + network.flat[-64:].tobytes()
    if key not in _seen:
        _seen.clear()
        _seen[key] = np.zeros(0, U64), np.zeros(0)
    codes, values = _seen[key]
    at = np.minimum(np.searchsorted(codes, distinct), max(len(codes) - 1, 0))
    known = codes[at] == distinct if len(codes) else np.zeros(len(distinct), bool)
    out = np.empty(len(distinct))
    out[known] = values[at[known]] if len(codes) else 0
    fresh = distinct[~known]
    found = np.concatenate([np.zeros(0), *(network.log_probabilities(fresh[i:i + 4096]) for i in range(0, len(fresh), 4096))])
    out[~known] = found
    if len(codes) + len(fresh) > _MOST_WINDOWS:
        _seen[key] = distinct, out
    elif len(fresh):
        both = np.concatenate([codes, fresh])
        order = np.argsort(both, kind="stable")
        _seen[key] = both[order], np.concatenate([values, found])[order]
    return out


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its identifier, ``n_tokens``, ``log_likelihood`` and ``per_token`` under the network of this very corpus.

    Rows that repeat, and equal texts, get equal scores up to rounding; null identifiers stay null; other columns are not read. Empty in,
    empty out.
    """
    network = train(cut_lineage(window_counts(docs, text_col)))
    name = free_name([id_col], "scored")
    return docs.select(id_col, score_of(F.col(text_col), network).alias(name)).select(id_col, f"{name}.*")
