from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from veilframe.llm import graph, jaccard
from veilframe.session import _CLEANUP


def test_near_copies_write_no_row_per_key_and_keep_no_shuffles(spark, monkeypatch):
    """The disk of the step: what is shuffled for a written table goes, and keys travel packed, not as a table."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(300)) for _ in range(60)]
    texts += [t + " tail" for t in texts[:20]]
    written, cut = [], jaccard.cut_lineage

    def watched(df):
        made = cut(df)
        written.append((spark.conf.get(_CLEANUP, None), made.count()))
        return made

    monkeypatch.setattr(jaccard, "cut_lineage", watched)
    monkeypatch.setattr(graph, "cut_lineage", watched)
    before = spark.conf.get(_CLEANUP, None)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in jaccard.drop_near_copies(docs, size=5, percent=80).collect()}
    assert kept == set(range(60))
    assert written and all(setting == "true" for setting, _ in written)
    assert max(rows for _, rows in written) < 10 * len(texts)  # a text has about 80 keys
    assert spark.conf.get(_CLEANUP, None) == before


def test_packed_keys_chain_all_nodes_that_share_one(spark):
    rng = np.random.default_rng(5)
    keys = [np.unique(rng.integers(0, 3000, rng.integers(0, 6)).astype(np.uint64)) for _ in range(800)]
    node = rng.integers(-(1 << 63), 1 << 63, 800)
    rows = pa.RecordBatch.from_arrays([pa.array(node), pa.array([k.tobytes() for k in keys], pa.binary())], ["node", "keys"])
    for buckets in (1, 7):
        packed = pa.Table.from_batches([b for part in (rows.slice(0, 300), rows.slice(300)) for b in jaccard._local_stars(buckets)(iter([part]))])
        in_order = packed.sort_by("bucket").to_batches(max_chunksize=3)
        sets, names = graph.Sets(800), {n: i for i, n in enumerate(node.tolist())}
        for batch in jaccard._key_edges(iter(in_order)):
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                sets.join(names[a], names[b])
        want, first = graph.Sets(800), {}
        for i, own in enumerate(keys):
            for k in own.tolist():
                want.join(first.setdefault(k, i), i)
        assert [sets.find(i) for i in range(800)] == [want.find(i) for i in range(800)]
        assert set(packed.column("bucket").to_pylist()) <= set(range(buckets))
