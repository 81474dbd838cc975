"""Packing tokenised documents into sequences by cutting-stock column generation.

Whole sequences are cut off the front of a document; what is left over, its tail, is shorter than a sequence. The tails'
length histogram (at most ``capacity`` numbers, whatever the corpus) is the demand of a cutting-stock problem: a linear
program over patterns of lengths, whose columns come from a knapsack dynamic program over the dual prices. Rounded
patterns that fill a sequence are dealt to the tails of each length by rank; tails that no such pattern takes are
poured end to end and cut at sequence borders. So padding is at most ``slack`` tokens in a pattern's sequence, and one
sequence is short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import U64, byte_hashes, lean, pieces, utf8
from veilframe.session import cut_lineage

CAPACITY = 1024
SLACK = 4
WHOLE = 1 << 62  # sequence numbers from here on hold one whole piece of one document
_CACHE_WORDS = 600_000
_CHUNK = 1 << 19
_TOKENS = "p int, row bigint, id bigint, n_tokens bigint, k bigint, whole_before bigint, ids binary"
_tokenizers: dict[str, tuple] = {}


class _Encoder:
    """Token ids of texts, from a table of known pieces.

    A blank opens a pre-token, so a text without two blanks in a row is the chain of its pieces, each up to the next
    blank; only pieces not seen before are tokenised, many in one call. A text with two blanks in a row is one piece.
    Pieces are known by two 64-bit hashes of their bytes. The table is bounded: when it is full it starts anew.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids whose token starts with a blank
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token[0] == "\u0120"
        self.forget()

    def forget(self) -> None:
        self.keys, self.checks = np.zeros(0, U64), np.zeros(0, U64)
        self.start, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _tokens(self, found: list[bytes], blank_led: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some pieces laid end to end, and their sizes; the blank-led pieces come first in ``found``."""
        led = int(blank_led.sum())
        lines = [b"".join(found[i:min(i + 64, led)]).decode() for i in range(0, led, 64)]
        encoded = [x for i in range(0, len(lines), 128) for x in self._encode(lines[i:i + 128])]
        ids = np.concatenate([*encoded, np.zeros(0, np.uint32)])
        sizes = np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))
        alone = self._encode([x.decode() for x in found[led:]])
        return np.concatenate([ids, *alone]).astype(np.uint32), np.r_[sizes, [len(x) for x in alone]].astype(np.int64)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as bytes and bounds, end to end, and the bounds of the texts in ids."""
        n, rows = len(data), len(bounds) - 1
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        blank = data == 0x20
        row = np.repeat(np.arange(rows), np.diff(bounds))
        twice = np.flatnonzero(blank[1:] & blank[:-1] & (row[1:] == row[:-1]))
        whole = np.zeros(rows, bool)
        whole[row[twice]] = True
        opens = blank & ~whole[row]
        opens[bounds[:-1][np.diff(bounds) > 0]] = True
        start = np.flatnonzero(opens)
        end = np.append(start[1:], n)
        keys, checks = (byte_hashes(data, start, end, i) for i in range(2))
        order = np.argsort(keys)
        head = np.r_[True, keys[order][1:] != keys[order][:-1]]
        first = order[head]
        distinct, which = keys[first], np.empty(len(keys), np.int64)
        which[order] = np.cumsum(head) - 1
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        known = (self.keys[at] == distinct) & (self.checks[at] == checks[first]) if len(self.keys) else np.zeros(len(distinct), bool)
        missing = np.flatnonzero(~known)
        if len(missing):
            if len(self.keys) + len(missing) > _CACHE_WORDS or len(self.pool) > 4 * _CACHE_WORDS:
                self.forget()
                missing = np.arange(len(distinct))
            place = first[missing]
            led = blank[start[place]] & ~whole[row[start[place]]]
            order = np.argsort(~led, kind="stable")
            missing, place, led = missing[order], place[order], led[order]
            raw = data.tobytes()
            ids, sizes = self._tokens([raw[a:b] for a, b in zip(start[place].tolist(), end[place].tolist())], led)
            merged = np.concatenate([self.keys, distinct[missing]])
            order = np.argsort(merged, kind="stable")
            self.keys = merged[order]
            self.checks = np.concatenate([self.checks, checks[place]])[order]
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(sizes) - sizes])[order]
            self.size = np.concatenate([self.size, sizes])[order]
            self.pool = np.concatenate([self.pool, ids])
            at = np.searchsorted(self.keys, distinct)
        size, source = self.size[at][which], self.start[at][which]
        total = np.cumsum(size)
        out = self.pool[np.repeat(source - (total - size), size) + np.arange(total[-1])]
        pieces_before = np.searchsorted(start, bounds)
        return out, np.r_[0, total][pieces_before]


def _encoder(path: str) -> _Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = _Encoder(path)
    return _tokenizers[path]


def tokenize(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
             capacity: int = CAPACITY) -> DataFrame:
    """A written table of token ids per row: the place of the row (p, row), its identifier, and in its task the number
    of earlier tails of its length (k) and of earlier whole sequences. Null text is empty: the end id alone."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer_path), TaskContext.get().partitionId()
        seen, whole, row = np.zeros(capacity, np.int64), 0, 0
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            for a, b in pieces(bounds, _CHUNK):
                ids, at = encoder.encode(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a])
                raw, limits = ids.tobytes(), (at * 4).tolist()
                out = np.empty((5, b - a), np.int64)
                for i, n in enumerate((np.diff(at) + 1).tolist()):
                    out[:, i] = (part << 40) + row, n, seen[n % capacity], whole, part
                    seen[n % capacity] += 1
                    whole += n // capacity
                    row += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[4].astype(np.int32)), pa.array(out[0]), batch.column("id").slice(a, b - a), pa.array(out[1]),
                     pa.array(out[2]), pa.array(out[3]),
                     pa.array([raw[x:y] + end for x, y in zip(limits, limits[1:])], pa.binary())],
                    ["p", "row", "id", "n_tokens", "k", "whole_before", "ids"])
        encoder.forget()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return cut_lineage(rows.mapInArrow(lean(run), _TOKENS))


def best_pattern(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the dearest multiset of lengths within the capacity, as counts per length."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            value = best[c - lengths[:fits[c]]] + prices[:fits[c]]
            i = int(value.argmax())
            if value[i] > best[c] + 1e-12:
                best[c], taken[c] = value[i], i
    counts, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            counts[taken[c]] += 1
            c -= lengths[taken[c]]
    return float(best[capacity]), counts


def solve_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.0005,
                   steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """The linear program "cover the demand with the fewest sequences" by column generation.

    Gives the basic patterns (a column each) and how often each is used (fractions). Stops when Farley's bound proves
    the optimum within ``gap``, or after ``steps`` columns: then it is a valid cover, only less tight.
    """
    n = len(lengths)
    basis, cost = np.zeros((n, n)), np.ones(n)
    where = {int(v): i for i, v in enumerate(lengths)}
    for i, v in enumerate(lengths):  # a length and its complement make a full sequence; the rest stands by itself
        j = where.get(capacity - int(v))
        basis[i, i] = capacity // v
        if j is not None and j != i and (demand[i], i) < (demand[j], j):
            basis[:, i] = 0
            basis[i, i] = basis[j, i] = 1
    inverse = np.linalg.inv(basis)
    used = inverse @ demand
    for step in range(steps):
        prices = cost @ inverse
        entering, price = np.zeros(n), 1.0
        if prices.min() < -1e-9:  # more than the demand may be covered
            entering[int(prices.argmin())], price = -1, 0.0
        else:
            value, counts = best_pattern(lengths, np.maximum(prices, 0), capacity)
            if value <= 1 + 1e-9 or cost @ used <= (prices @ demand) / value * (1 + gap):
                break
            entering = counts.astype(float)
        change = inverse @ entering
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out], cost[out] = entering, price
        pivot = inverse[out] / change[out]
        inverse -= np.outer(change, pivot)
        inverse[out] = pivot
        if step % 100 == 99:
            inverse = np.linalg.inv(basis)
        used = np.maximum(inverse @ demand, 0)
    real = cost > 0
    return basis[:, real].astype(np.int64), used[real]


@dataclass(frozen=True)
class Plan:
    """Where the tail of a length and rank goes. Intervals of ranks, sorted by (length, first rank): ``copies`` tails in a
    row share a sequence, from ``sequence`` on, at ``offset``; ``copies`` 0 marks poured tails, and ``offset`` is then
    their place in the stream of poured tokens. All of it is bounded by the capacity, not by the corpus."""

    length: np.ndarray
    rank: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int  # those of patterns; poured ones follow
    capacity: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per tail its interval's sequence and offset; for poured ones those of the first token."""
        big = np.int64(1) << 52
        at = np.searchsorted(self.length * big + self.rank, length * big + rank, side="right") - 1
        step, copies = rank - self.rank[at], self.copies[at]
        poured = copies == 0
        of = np.where(poured, 1, copies)
        position = self.offset[at] + step * length
        sequence = np.where(poured, self.sequences + position // self.capacity, self.sequence[at] + step // of)
        offset = np.where(poured, position % self.capacity, self.offset[at] + step % of * length)
        return sequence, offset


def plan_tails(histogram: dict[int, int], capacity: int = CAPACITY, slack: int = SLACK) -> Plan:
    """Patterns for the tails of a corpus, from the number of tails of each length (1 to capacity - 1)."""
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0 and 0 < k < capacity), np.int64)
    demand = np.array([histogram[int(k)] for k in lengths], np.int64)
    left, intervals, sequences = demand.copy(), [], 0
    if len(lengths):
        patterns, used = solve_patterns(lengths, demand.astype(float), capacity)
        full = capacity - lengths @ patterns <= slack
        patterns, used = patterns[:, full], used[full]
        for whole in (True, False):  # the integral parts first, then one more of those with the largest fractions
            for j in np.argsort(-(used if whole else used % 1), kind="stable"):
                pattern = patterns[:, j]
                kinds = np.flatnonzero(pattern)
                times = int(min(used[j] + 1e-6 if whole else 1, (left[kinds] // pattern[kinds]).min()))
                if times <= 0:
                    continue
                offset = 0
                for i in kinds[::-1]:
                    intervals.append((lengths[i], demand[i] - left[i], pattern[i], sequences, offset))
                    left[i] -= times * pattern[i]
                    offset += lengths[i] * pattern[i]
                sequences += times
    stream = 0
    for i in np.flatnonzero(left):
        intervals.append((lengths[i], demand[i] - left[i], 0, 0, stream))
        stream += int(left[i]) * int(lengths[i])
    table = np.array(sorted(intervals, key=lambda x: (x[0], x[1])), np.int64).reshape(-1, 5).T
    return Plan(*table, sequences, capacity)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
         capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """Pieces of documents with their place in sequences of at most ``capacity`` tokens.

    Columns: the identifier, ``start`` (tokens of the document before the piece), ``length``, ``doc_tokens`` (the end id
    counts), ``sequence_id``, ``offset`` (in the sequence, gapless from 0) and ``ids`` (little-endian 32-bit words).
    Every row is packed for itself, also those that repeat an identifier or have none; null and empty texts are the end
    id alone. Other columns are not read. Empty in, empty out.
    """
    tokens = tokenize(docs, tokenizer_path, id_col, text_col, end_id, capacity)
    tail = (F.col("n_tokens") % capacity).alias("tail")
    counts = tokens.select("p", tail).where("tail > 0").groupBy("p", "tail").agg(F.count("*").alias("n"))
    counts = cut_lineage(counts)
    histogram = {r["tail"]: r["n"] for r in counts.groupBy("tail").agg(F.sum("n").alias("n")).collect()}
    plan = plan_tails(histogram, capacity, slack)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "tail", "rank"))
            sequence, offset = plan.place(length, rank)
            first = np.minimum(length, capacity - offset)  # a poured tail may run on into the next sequence
            cut = first < length
            out = [np.r_[row, row[cut]], np.r_[np.zeros_like(length), first[cut]], np.r_[first, (length - first)[cut]],
                   np.r_[sequence, sequence[cut] + 1], np.r_[offset, np.zeros_like(offset[cut])]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["row", "cut", "length", "sequence_id", "offset"])

    earlier = Window.partitionBy("tail").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("p", "tail", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = tokens.select("row", "p", "k", tail).where("tail > 0").join(bases, ["p", "tail"]).select(
        "row", "tail", (F.col("base") + F.col("k")).alias("rank"))
    placed = ranked.mapInArrow(
        lean(assign), "row bigint, cut bigint, length bigint, sequence_id bigint, offset bigint")

    def words(start, length):
        return F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (length * 4).cast("int"))

    whole = (F.col("n_tokens") / capacity).cast("bigint")
    fronts = tokens.where(F.col("n_tokens") >= capacity).select(
        "id", "n_tokens", "p", "whole_before", "ids", F.explode(F.sequence(F.lit(0), whole - 1)).alias("j")).select(
        F.col("id").alias(id_col), (F.col("j") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("length"),
        F.col("n_tokens").alias("doc_tokens"),
        (F.lit(WHOLE) + F.col("p").cast("bigint") * (1 << 40) + F.col("whole_before") + F.col("j")).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"), words(F.col("j") * capacity, F.lit(capacity)).alias("ids"))
    tails = tokens.where(tail > 0).select("row", "id", "n_tokens", words(whole * capacity, tail).alias("ids"))
    rest = tails.join(placed, "row").select(
        F.col("id").alias(id_col), (whole * capacity + F.col("cut")).alias("start"), "length",
        F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset", words(F.col("cut"), F.col("length")).alias("ids"))
    return fronts.unionByName(rest)


def sequences(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` (little-endian 32-bit words, without padding) and
    ``pieces`` (identifier, start, length, offset) in order. A sequence has at most ``capacity`` pieces."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.col(id_col), "start", "length", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return grouped.select("sequence_id", joined.alias("ids"), F.transform("parts", lambda x: F.struct(
        x[id_col].alias(id_col), x["start"].alias("start"), x["length"].alias("length"), x["offset"].alias("offset"))).alias("pieces"))
