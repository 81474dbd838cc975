"""What several operators share: table access, hashing of bytes in numpy, Arrow batches as flat byte buffers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
BATCH_BYTES = 4 << 20
_FACTOR = U64(0x9E3779B97F4A7C15)


def small_batches(spark: SparkSession) -> None:
    """Rows with whole texts travel to Python in batches of some megabytes, whatever their number."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return what this worker does not use: workers are reused, and a later stage needs the room."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, with unused memory given back when its task ends."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return outer


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, lengthened until it clashes with no column (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def random_words(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1_000_003)) * _FACTOR)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column laid end to end, and the n + 1 bounds of its rows. Null counts as empty."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    if pa.types.is_string(values.type):
        values = values.cast(pa.large_string())
    elif pa.types.is_binary(values.type):
        values = values.cast(pa.large_binary())
    if values.null_count:
        values = values.fill_null("" if pa.types.is_large_string(values.type) else b"")
    n = len(values)
    _, offsets, data = values.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[values.offset:values.offset + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def pieces(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes each; a longer row stands alone."""
    n, at = len(bounds) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U64(0xD6E8FEB86659FD93)
_UNBASE = U64(pow(int(_BASE), -1, 1 << 64))
_BYTE = random_words(7, 256)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_BASE ** i`` and its inverse for i below at least ``n``, modulo 2**64."""
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _POWERS:
        out = []
        for base in (_BASE, _UNBASE):
            p = np.full(size, base, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS.clear()
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def word_hashes(data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Words are runs of bytes outside ``breaks`` (by default space and 09-0D), with A-Z in lower case.

    Gives a 64-bit hash per word, and the n + 1 bounds of the rows in words. Rows never share a word.
    """
    n = len(data)
    rows = len(bounds) - 1
    if n == 0:
        return np.zeros(0, U64), np.zeros(rows + 1, np.int64)
    space = breaks[data]
    first = ~space
    first[1:] &= space[:-1]
    inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < n)]
    first[inner] = ~space[inner]
    last = ~space
    last[:-1] &= space[1:]
    last[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(_BYTE[_LOWER[data]] * up[:n], dtype=U64, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * _FACTOR)
    return hashes, np.searchsorted(starts, bounds, side="left").astype(np.int64)


_RAW_BYTES = [random_words(11, 256), random_words(12, 256)]


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of each byte range; ``which`` picks one of two independent ones."""
    up, down = _powers(len(data))
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum(_RAW_BYTES[which][data] * up[:len(data)], dtype=U64, out=total[1:])
    return mix((total[end] - total[start]) * down[np.minimum(start, len(down) - 1)] + (end - start).astype(U64) * _FACTOR)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row, in order, with the bounds of the rows.

    A row with fewer words has none, or, with ``whole``, one for its whole sequence if it has a word at all.
    """
    counts = np.diff(bounds)
    kept = np.maximum(counts - size + 1, 0)
    out_bounds = np.zeros(len(bounds), np.int64)
    short = (counts > 0) & (counts < size)
    out_bounds[1:] = np.cumsum(kept + (short if whole else 0))
    out = np.empty(out_bounds[-1], U64)
    n = len(words) - size + 1
    if n > 0:
        rolled = np.zeros(n, U64)
        for i in range(size):
            rolled *= _BASE
            rolled += words[i:i + n]
        rolled = mix(rolled)
        row = np.repeat(np.arange(len(counts)), kept)
        within = np.arange(len(row)) - np.repeat(np.cumsum(kept) - kept, kept)
        out[out_bounds[row] + within] = rolled[bounds[row] + within]
    if whole:
        for r in np.flatnonzero(short):
            code = int(counts[r])
            for w in words[bounds[r]:bounds[r + 1]].tolist():
                code = (code * int(_BASE) + w) & 0xFFFFFFFFFFFFFFFF
            out[out_bounds[r]] = mix(np.array([code ^ 0x5DEECE66D], U64))[0]
    return out, out_bounds


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` values in a row, by doubling."""
    if len(x) < width:
        return x[:0]
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit words as Spark longs."""
    return np.ascontiguousarray(x).view(np.int64)
