"""Hard negatives by threshold joins in the manner of L2AP.

Vectors are integers. Anchors are a stated query set, taken in blocks of bounded size, each block against all rows. A task
holds some rows at a time. Their dimensions are ordered by weight, heaviest first, and laid into an inverted index, in groups of
dimensions; the end of a vector whose norm, times the largest such norm of an anchor, cannot reach the least threshold is left
out of it. Scores are accumulated group by group; a pair whose partial score plus the product of the norms of what remains
lies below its anchor's threshold is dropped. What is left is multiplied out in full.

An anchor's first threshold is guessed from the scores of a bounded sample of rows, so that a few dozen rows are expected above
it. While a window (the best positives; the best negatives below a share of a positive's score) is not full, its threshold is
lowered and the anchor asked again, until it is full or the window's lower end is reached. So the guess decides how much
work is done, never what comes out. In a task, full windows raise the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import lean
from veilframe.session import cut_lineage

ANCHOR_BYTES = 4 << 20  # vectors of anchors handled at once
SAMPLE = 2000  # rows from which thresholds are guessed, about
EXPECTED = 40  # rows expected above the first threshold; 16 times as many above each later one
GROUP = 8  # dimensions accumulated between two prunings
TILE_ANCHORS, TILE_ROWS = 512, 2048
LARGEST = 1 << 22  # components of this size or more would leave the range of exact sums
NO_ID = np.iinfo(np.int64).max
LOWEST = -float(1 << 60)


def usable(vector: Column) -> Column:
    """No null vector, and no null, infinite or undefined component."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def scaled(vector: Column, by: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * by))


@dataclass
class Asked:
    """What a round asks: anchors by number, and per window its anchor, its threshold and its upper end (inclusive)."""

    anchors: np.ndarray
    vectors: np.ndarray  # of the anchors, as doubles
    labels: np.ndarray
    rows: np.ndarray  # the anchors' own rows
    window_anchor: np.ndarray
    least: np.ndarray
    most: np.ndarray


def _pairs(a: np.ndarray, x: np.ndarray, least: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All allowed pairs (anchor, row) whose inner product reaches the anchor's ``least``, with the product."""
    m, d = a.shape
    n = len(x)
    order = np.argsort(-(a * a).sum(axis=0) * (x * x).sum(axis=0), kind="stable")
    a, x = a[:, order], x[:, order]
    cuts = [*range(0, d, GROUP), d]
    rest_a = np.sqrt(np.array([(a[:, c:] ** 2).sum(axis=1) for c in cuts]))  # groups + 1, anchors
    rest_x = np.sqrt(np.array([(x[:, c:] ** 2).sum(axis=1) for c in cuts]))
    # Groups of a row that are in the index: from ``ends`` on, what is left can reach no threshold by itself.
    within = rest_x * rest_a.max(axis=1)[:, None] * (1 + 1e-9) < least.min()
    ends = np.where(within.any(axis=0), within.argmax(axis=0), len(cuts) - 1)
    alive, slack = allowed, 1 + 1e-9
    partial = np.zeros((m, n))
    at = len(cuts) - 1
    for group in range(len(cuts) - 1):
        listed = np.flatnonzero((ends > group) & (x[:, cuts[group]:cuts[group + 1]] != 0).any(axis=1))
        if len(listed):
            block = x[listed, cuts[group]:cuts[group + 1]]
            partial[:, listed] += a[:, cuts[group]:cuts[group + 1]] @ block.T
        done = np.minimum(group + 1, ends)
        bound = partial + rest_a[done].T * rest_x[done, np.arange(n)][None, :] * slack + 1e-6
        alive = alive & (bound >= least[:, None])
        if alive.mean() < 0.1:
            at = group + 1
            break
    i, j = np.nonzero(alive)
    # Few are left: pair by pair, with the same bounds, to the end of the index.
    score = partial[i, j]
    for group in range(at, len(cuts) - 1):
        open_ = ends[j] > group
        score[open_] += np.einsum("ij,ij->i", a[i[open_], cuts[group]:cuts[group + 1]], x[j[open_], cuts[group]:cuts[group + 1]])
        done = np.minimum(group + 1, ends[j])
        keep = score + rest_a[done, i] * rest_x[done, j] * slack + 1e-6 >= least[i]
        i, j, score = i[keep], j[keep], score[keep]
    exact = np.zeros(len(i))
    for s in range(0, len(i), 1 << 16):
        p = slice(s, s + (1 << 16))
        exact[p] = np.einsum("ij,ij->i", a[i[p]], x[j[p]])
    good = exact >= least[i]
    return i[good], j[good], exact[good].astype(np.int64)


def _ranks(group: np.ndarray) -> np.ndarray:
    """The place of each element in its run of equal values."""
    if not len(group):
        return np.zeros(0, np.int64)
    head = np.r_[True, group[1:] != group[:-1]]
    return np.arange(len(group)) - np.maximum.accumulate(np.where(head, np.arange(len(group)), 0))


def _search(rows: DataFrame, asked: Asked, same: bool, k: int) -> DataFrame:
    """The k best rows of each window in each task: (window, score, id, row)."""
    by_anchor = np.argsort(asked.window_anchor, kind="stable")
    first = np.searchsorted(asked.window_anchor[by_anchor], np.arange(len(asked.anchors)))
    last = np.searchsorted(asked.window_anchor[by_anchor], np.arange(len(asked.anchors)), side="right")
    d = asked.vectors.shape[1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = asked.least.copy()
        kept = [np.zeros(0, np.int64) for _ in range(4)]  # window, score, id, row

        def take(ids, own, labels, x) -> None:
            nonlocal kept
            for lo in range(0, len(asked.anchors), TILE_ANCHORS):
                part = slice(lo, lo + TILE_ANCHORS)
                equal = asked.labels[part][:, None] == labels[None, :]
                allowed = (equal if same else ~equal) & (asked.rows[part][:, None] != own[None, :])
                floor = np.array([least[by_anchor[first[i]:last[i]]].min() for i in range(lo, min(lo + TILE_ANCHORS, len(asked.anchors)))])
                i, j, score = _pairs(asked.vectors[part], x, floor, allowed)
                i = i + lo
                counts = (last - first)[i]
                pair = np.repeat(np.arange(len(i)), counts)
                window = by_anchor[np.repeat(first[i], counts) + np.arange(len(pair)) - np.repeat(np.cumsum(counts) - counts, counts)]
                inside = (score[pair] >= least[window]) & (score[pair] <= asked.most[window])
                pair, window = pair[inside], window[inside]
                fresh = window, score[pair], ids[j[pair]], own[j[pair]]
                kept = [np.concatenate([old, new]) for old, new in zip(kept, fresh)]
            order = np.lexsort((kept[3], kept[2], -kept[1], kept[0]))
            kept = [c[order] for c in kept]
            rank = _ranks(kept[0])
            full = rank == k - 1  # a full window asks for nothing below its last score any more
            least[kept[0][full]] = np.maximum(least[kept[0][full]], kept[1][full])
            kept = [c[rank < k] for c in kept]

        for batch in batches:
            for at in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(at, TILE_ROWS)
                fits = part.column("vec").value_lengths().to_numpy(zero_copy_only=False) == d
                part = part.filter(pa.array(fits))
                if part.num_rows and d:
                    x = part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                    take(part.column("id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False), part.column("row").to_numpy(zero_copy_only=False),
                         part.column("label").to_numpy(zero_copy_only=False), x)
        if len(kept[0]):
            yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[1]), pa.array(kept[2], mask=kept[2] == NO_ID),
                                              pa.array(kept[3])], ["window", "score", "id", "row"])

    found = rows.mapInArrow(lean(search), "window bigint, score bigint, id bigint, row bigint")
    best = Window.partitionBy("window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _guess(mean: np.ndarray, deviation: np.ndarray, n: np.ndarray, most: np.ndarray, expected: float) -> np.ndarray:
    """Where about ``expected`` of n normal scores lie between the threshold and ``most``."""
    normal, out = NormalDist(), np.full(len(mean), LOWEST)
    for i in range(len(mean)):
        if deviation[i] > 0:
            share = expected / max(n[i], 1.0) + (1 - normal.cdf((most[i] - mean[i]) / deviation[i]) if most[i] < -LOWEST else 0.0)
            if share < 0.5:
                out[i] = np.floor(mean[i] - deviation[i] * normal.inv_cdf(max(share, 1e-300)))
    return out


def _rounds(rows: DataFrame, anchors: dict, same: bool, window_anchor, low, high, statistics, k: int) -> list[DataFrame]:
    """Tables (window, score, id, row, rank) that together hold each window's k best rows, or all, if there are fewer."""
    mean, deviation, n = statistics
    todo, expected, tables = np.arange(len(window_anchor)), float(EXPECTED), []
    while len(todo):
        owner = window_anchor[todo]
        least = np.maximum(_guess(mean[owner], deviation[owner], n[owner], high[todo], expected), low[todo])
        numbers, local = np.unique(owner, return_inverse=True)
        asked = Asked(numbers, anchors["vectors"][numbers], anchors["labels"][numbers], anchors["rows"][numbers], local, least, high[todo])
        spark = rows.sparkSession
        found = cut_lineage(_search(rows, asked, same, k))
        full = {r["window"] for r in found.where(F.col("rank") == k).select("window").collect()}
        ready = np.array([w in full for w in range(len(todo))]) | (least <= low[todo])
        names = spark.createDataFrame([(int(w), int(todo[w])) for w in np.flatnonzero(ready)], "window bigint, number bigint")
        tables.append(found.join(F.broadcast(names), "window").drop("window").withColumnRenamed("number", "window"))
        todo, expected = todo[~ready], expected * 16
    return tables


def _statistics(anchors: dict, sample: list, n_rows: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and expected number of the scores of each anchor with rows of its own label, or of others."""
    d = anchors["vectors"].shape[1]
    sample = [r for r in sample if len(r["vec"]) == d]
    m = len(anchors["rows"])
    if not sample:
        return np.zeros(m), np.zeros(m), np.full(m, float(n_rows))
    scores = anchors["vectors"] @ np.array([r["vec"] for r in sample], float).T
    mask = (anchors["labels"][:, None] == np.array([r["label"] for r in sample])[None, :]) == same
    mask &= anchors["rows"][:, None] != np.array([r["row"] for r in sample])[None, :]
    count = mask.sum(axis=1)
    mean = (scores * mask).sum(axis=1) / np.maximum(count, 1)
    deviation = np.sqrt(((scores - mean[:, None]) ** 2 * mask).sum(axis=1) / np.maximum(count, 1))
    return mean, np.where(count >= 8, deviation, 0), np.maximum(count, 1) * n_rows / len(sample)


def mine_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """For each anchor row and each of its ``positives`` best other rows of the same label, the ``negatives`` best rows of other
    labels whose score is at least ``low`` and at most ``high`` percent of the positive's.

    ``vector_col`` holds integers (see ``scaled``). Result: (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score). Equal scores come by identifier, null ones last, then by row. Rows with a null label or vector, a null
    component or one of 2**22 or more in size take no part; only vectors of the anchor's length are compared, and empty ones
    never. Repeated rows are rows of their own; an anchor that is repeated is asked, and answered, as often.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("bigint").alias("label"),
                          F.col(f"`{vector_col}`").cast("array<bigint>").alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    sound = F.col("vec").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False)))
    rows = cut_lineage(rows.where(sound).withColumn("row", F.monotonically_increasing_id()).withColumn("vec", F.col("vec").cast("array<int>")))
    total = rows.agg(F.count("*").alias("n"), F.sum(F.when(F.col("anchor"), F.size("vec") * 4 + 32)).alias("bytes")).first()
    blocks = -(-(total["bytes"] or 0) // ANCHOR_BYTES)
    share = min(1.0, SAMPLE / max(total["n"], 1))
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < share * (1 << 30)).select("row", "label", "vec").collect() if blocks else []
    shape = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    out = []
    for block in range(blocks):
        mine = rows.where(F.col("anchor") & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == block)).orderBy("id", "row").collect()
        for d in sorted({len(r["vec"]) for r in mine}):
            own = [r for r in mine if len(r["vec"]) == d]
            anchors = {"vectors": np.array([r["vec"] for r in own], float), "labels": np.array([r["label"] for r in own], np.int64),
                       "rows": np.array([r["row"] for r in own], np.int64)}
            every = np.arange(len(own))
            ends = np.full(len(own), LOWEST), np.full(len(own), -LOWEST)
            best = _rounds(rows, anchors, True, every, *ends, _statistics(anchors, sample, total["n"], True), positives)
            pairs = sorted((tuple(r) for t in best for r in t.select("window", "rank", "id", "score").collect()), key=lambda r: r[:2])
            if not pairs:
                continue
            owner, score = np.array([p[0] for p in pairs]), np.array([p[3] for p in pairs])
            lower, upper = -((-low * score) // 100), (high * score) // 100
            some = np.flatnonzero(lower <= upper)
            names = spark.createDataFrame([(n, own[owner[w]]["id"], pairs[w][2], int(score[w])) for n, w in enumerate(some.tolist())],
                                          "window bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
            found = _rounds(rows, anchors, False, owner[some], lower[some].astype(float), upper[some].astype(float),
                            _statistics(anchors, sample, total["n"], False), negatives)
            out += [t.join(F.broadcast(names), "window").select(
                "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
                for t in found]
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], shape)
