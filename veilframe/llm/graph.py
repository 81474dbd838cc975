"""Connected components of a written edge table, and work on groups of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import lean
from veilframe.session import cut_lineage


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _settled(edges: DataFrame) -> bool:
    """Whether (a, b) are stars around their least nodes: every a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("a_side"), F.lit(0).alias("b_side")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("a_side").alias("x"), F.max("b_side").alias("y"))
    return seen.where("x > 1 OR (x = 1 AND y = 1)").isEmpty()


def _contract(chunk: int):
    """Within a task and ``chunk`` edges, replace the edges by stars around the least node of each component."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ends = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]).combine_chunks().dictionary_encode()
        names = ends.dictionary
        rank = np.empty(len(names), np.int64)
        order = pc.sort_indices(names).to_numpy()
        rank[order] = np.arange(len(names))
        place = rank[ends.indices.to_numpy()]
        half = len(place) // 2
        sets = Sets(len(names))
        for x, y in zip(place[:half].tolist(), place[half:].tolist()):
            sets.join(x, y)
        root = np.array([sets.find(i) for i in range(len(names))])
        other = np.flatnonzero(root != np.arange(len(names)))
        ordered = names.take(pa.array(order))
        return pa.RecordBatch.from_arrays([ordered.take(pa.array(other)), ordered.take(pa.array(root[other]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= chunk:
                yield stars(held)
                held, size = [], 0
        if size:
            yield stars(held)

    return run


def components(edges: DataFrame, chunk: int = 200_000) -> DataFrame:
    """``node`` and ``root`` (the least node that it reaches) for all nodes on the edges (a, b).

    Edges are contracted to stars within tasks of at most ``chunk`` edges. If more than one task was needed, large-star and
    small-star rounds follow: each links the neighbours of a node to its least neighbour, so paths shrink by halves.
    Minima are pre-aggregated; no neighbourhood is gathered. Each round is a written table. Null ends are ignored; loops
    count as nodes; no edges give no rows.
    """
    edges = cut_lineage(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b"))
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    schema = f"a {edges.schema['a'].dataType.simpleString()}, b {edges.schema['b'].dataType.simpleString()}"
    while True:
        tasks = -(-now.count() // chunk)
        now = cut_lineage(now.coalesce(max(tasks, 1)).mapInArrow(lean(_contract(chunk)), schema))
        if tasks <= 1 or _settled(now):
            break
        both = _both(now)
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.where("a <> b"))
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = cut_lineage(small.where("a <> b").distinct())
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    own = now.select(F.col("b").alias("node")).union(edges.where("a = b").select("a")).select("node", F.col("node").alias("root"))
    # A looped node is its own root only where no star has it.
    return stars.union(own).groupBy("node").agg(F.min("root").alias("root"))


def each_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str,
               order: list[str] = ()) -> DataFrame:
    """Run ``work`` on the rows of each key, which must be few: callers cut groups to a stated size first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            start = 0
            for i, key in enumerate(rows):
                if key != last:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        out = work(pa.Table.from_batches(held))
                        if out is not None and out.num_rows:
                            yield out
                    held, start, last = [], i, key
            held.append(batch.slice(start))
        if held:
            out = work(pa.Table.from_batches(held))
            if out is not None and out.num_rows:
                yield out

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInArrow(lean(run), schema)


class Sets:
    """Disjoint sets over 0..n-1, with the least member as root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
