"""Running combinations, located matches and overlaps of many spans against sequential Python."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from veilframe.config import DetectOptions
from veilframe.functions import scans, spans
from veilframe.functions.detect import detect
from veilframe.streaming.state import Early

RANDOM = random.Random(17)


def test_running_combinations(spark):
    rows = [(i, [RANDOM.choice([None, *range(-5, 9)]) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 7, 8, 9, 100])]
    frame = spark.createDataFrame(rows, "i int, v array<int>")
    whole = F.transform("v", lambda x: F.coalesce(x, F.lit(0)))
    got = {r["i"]: r for r in frame.select("i", scans.running_sums(whole).alias("s"), scans.running_max(F.col("v")).alias("m")).collect()}
    for i, v in rows:
        assert got[i]["s"] == [sum(x or 0 for x in v[:k + 1]) for k in range(len(v))]
        assert got[i]["m"] == [max((x for x in v[:k + 1] if x is not None), default=None) for k in range(len(v))]


def test_located(spark):
    texts = ["", "none", "a1b22c", "1", "\u00011\u0001 éé 22 😀 3", "7 8 9", " ".join(f"k{i} {i}" for i in range(3000))]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", scans.located(F.col("t"), "(?<![a-z0-9])[0-9]++").alias("x"),
                          spans.located_matches(F.col("t"), "(?<![a-z0-9])([0-9])([0-9]*+)", 2).alias("y")).collect():
        want = [(m.start(), m.group()) for m in re.finditer("(?<![a-z0-9])[0-9]+", r["t"])]
        assert [(x["at"], x["value"]) for x in r["x"]] == want == [(y["at"], y["full"]) for y in r["y"]]
        assert all(y["g1"] + y["g2"] == y["full"] for y in r["y"])


def test_many_overlaps_equal_the_plain_rule(spark):
    def spread(n, reach):
        found = []
        for _ in range(n):
            start = RANDOM.randrange(reach)
            end = start + RANDOM.randint(1, 9)
            found.append((RANDOM.randrange(4), start, end, RANDOM.randrange(3), "v", "T", "high", "p", start, end))
        return found

    rows = [(i, spread(n, reach)) for i, (n, reach) in enumerate([(0, 9), (3, 9), (49, 30), (60, 400), (300, 500), (900, 9000), (700, 60)])]
    rows.append((99, [(s + 3, *rest) for s, *rest in spread(80, 200)]))  # stages beyond those that are swept
    frame = spark.createDataFrame(rows, f"i int, c {spans.NO_CANDIDATES}")
    got = {r["i"]: [(f["start"], f["end"]) for f in r["f"]] for r in frame.select("i", spans.resolve_overlaps(F.col("c")).alias("f")).collect()}
    for i, found in rows:
        taken = []
        for c in sorted(found):
            if not any(t[1] < c[2] and c[1] < t[2] for t in taken):
                taken.append(c)
        assert got[i] == sorted((t[1], t[2]) for t in taken), i


def test_detection_grows_with_the_text(spark):
    def seconds(n):
        text = " ".join(f"ghp_{i:036d}" for i in range(n))
        found = detect(F.col("t"), DetectOptions(context=False, entropy=False))
        frame = spark.createDataFrame([(text,)], "t string").select(F.transform(found, lambda f: f["start"]).alias("starts"))
        began = time.perf_counter()
        assert frame.first()["starts"] == [41 * i for i in range(n)]
        return time.perf_counter() - began

    short, long = seconds(10_000), seconds(100_000)
    assert seconds(16_000) < 40 and long < 10 * short + 60  # minutes, when every span was compared with every other


def test_early_rows_in_blocks(monkeypatch):
    monkeypatch.setattr("veilframe.streaming.state.BLOCK", 4)
    monkeypatch.setattr("veilframe.streaming.state.BLOCKS", 2)

    class Store(dict):
        def getValue(self, key):
            return self[key]

        def updateValue(self, key, value):
            self[key] = value

        def removeKey(self, key):
            del self[key]

    store, blocks, waiting = Store(), [], {}
    for _ in range(30):
        early = Early(store, blocks)
        for _ in range(20):
            seq = RANDOM.randrange(60)
            if RANDOM.random() < 0.6:
                assert early.put(seq, [seq], False) == (seq not in waiting)
                waiting.setdefault(seq, [[seq], False])
            else:
                assert early.pop(seq) == waiting.pop(seq, None)
            assert early.first() == min(waiting, default=None) and len(early.blocks) <= 3
        blocks = early.keep()
        assert sorted(k[0] for k in store) == blocks == sorted({s // 4 for s in waiting})
