"""Personal data, ranked search and hard negatives against brute force."""

from __future__ import annotations

import math
import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import negatives, privacy, ranked

sys.path.insert(0, os.path.dirname(__file__))
from test_documents import prose  # noqa: E402

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def check_digit(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m.group().split(".")),
                    "card": 16 <= len(digits) <= 19 and check_digit(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def card(rng):
    head = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    return next(head + str(d) for d in range(10) if check_digit(head + str(d)))


def phone(rng):
    return f"+1 ({rng.randrange(100, 1000)}) 555-{rng.randrange(1000, 10000)}"


def ip(rng):
    return ".".join(str(rng.randrange(1, 255)) for _ in range(4))


AWKWARD = [
    None, "", " ", "@", "a@b", "a@b.c@d.e", "a@b.c%d@e.f x_@y.z.", "\u0001a@b.co\u0001 é😀 1.2.3.4", "1.2.3.4.5.6.7.8 1.2.3.4.5", "256.1.1.1 1.1.1.256",
    "0001.02.255.0", "1" * 3000, "1 " * 2000, "+" * 500, "+1" + "." * 3000, "+1 2345 678 9)", "+1", "+12", "a" * 4000, "a." * 2000 + "@x.y", "1.1" * 500,
    "4111 1111 1111 1111", "4111-1111-1111-1111 2", "4111  1111", "+1 (269) 555-3296 4524132264652876", "4451718024887799 27.65.93.188",
]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(AWKWARD)]
    for i in range(400):
        parts = [prose(rng, 20)]
        for make in (card, phone, ip, lambda r: f"joe.{r.randrange(99)}@mail.example.com"):
            if rng.random() < 0.4:
                parts += [make(rng), prose(rng, 6)]
        parts += [rng.choice(["", "Version 1.2.3", "token = 9f" + str(rng.randrange(10**13, 10**14)), "on 2024-01-05"])]
        rows.append((1000 + i, " ".join(parts)))
    rows += [(2000, f"{phone(rng)} {card(rng)} end"), (2001, next(t for t in iter(lambda: f"pay {card(rng)} {ip(rng)} now", 0) if len(base_spans(t)) == 1)), (2002, prose(rng, 30)), (1000, rows[-1][1]), (None, "a@b.co")]
    rows.append((3000, " ".join(f"u{i}@h{i % 7}.org" for i in range(3000))))
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, kind int, personal string").repartition(3)


def test_personal_data(spark, corpus):
    rows, frame = corpus
    model = privacy.learn(frame)
    found = privacy.find_personal_data(frame, model)
    assert found.columns == ["doc_id", "text", "kind", "personal", "personal_"]
    got = found.select("doc_id", "text", "personal_", privacy.redacted(F.coalesce("text", F.lit("")), F.col("personal_")).alias("clean")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    for r in got:
        spans = [(s["kind"], s["start"], s["end"]) for s in r["personal_"]]
        assert [s for s, x in zip(spans, r["personal_"]) if not x["added"]] == base_spans(r["text"]), r["doc_id"]
        assert spans == sorted(spans, key=lambda s: (privacy.KINDS.index(s[0]), s[1]))
        taken = [(s["start"], s["end"]) for s in r["personal_"] if s["added"]]
        for a, b in taken:  # what is added overlaps nothing
            assert sum(x["start"] < b and a < x["end"] for x in r["personal_"]) == 1
        text, want, at = r["text"] or "", [], 0
        for start, end, kind in sorted((s["start"], s["end"], s["kind"]) for s in r["personal_"]):
            want += [text[at:start]] if start > at else []
            want += [f"[{kind}]"] if end > at else []
            at = max(at, end)
        assert r["clean"] == "".join(want) + text[at:]
    by_id = {r["doc_id"]: r for r in got}
    added = {i: [r["text"][s["start"]:s["end"]] for s in by_id[i]["personal_"] if s["added"]] for i in (2000, 2001, 2002) for r in [by_id[i]]}
    assert len(added[2000]) == 2 and len(added[2001]) == 1 and added[2002] == []
    assert sum(s["added"] for i in range(1000, 1400) for s in by_id[i]["personal_"]) <= 2  # texts of the usual form are left alone


def test_personal_data_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert privacy.learn(empty) == privacy.NOTHING and privacy.personal_data(empty).collect() == []
    plain = spark.createDataFrame([(1, "nothing here"), (2, None)], "doc_id long, text string")
    assert [r["personal"] for r in privacy.personal_data(plain).collect()] == [[], []]


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    cells = {f: rng.integers(0, n, 300) for f, n in privacy.FEATURES.items()}
    truth = (cells["valid"] == 1) & (cells["left"] <= 1) | (cells["digits"] == 6)
    ones, zeros = np.where(truth, 9.0, 1.0), np.where(truth, 1.0, 9.0)
    trees, start = privacy.boost(cells, ones, zeros)
    score = privacy.Model(trees, (), start).scores(cells)
    assert score[truth].min() > score[~truth].max() - 1e-9
    least, probability = privacy.isotonic(score, ones, zeros)
    assert (np.diff(probability) > 0).all() and (np.diff(least) > 0).all() and probability[-1] == pytest.approx(0.9, abs=0.03)


def test_trees_are_the_same_as_columns(spark):
    rng = np.random.default_rng(2)
    cells = {f: rng.integers(0, n, 60) for f, n in privacy.FEATURES.items()}
    trees, start = privacy.boost(cells, rng.integers(0, 9, 60).astype(float), rng.integers(1, 9, 60).astype(float))
    model = privacy.Model(trees, (0.0,) * 4, start)
    frame = spark.createDataFrame([tuple(int(cells[f][i]) for f in cells) + (i,) for i in range(60)], ", ".join(f"{f} int" for f in cells) + ", i int")
    got = frame.select("i", model.column(F.struct(*cells)).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == pytest.approx(list(model.scores(cells)))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranking(docs, items, k):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    total, words = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    w = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, c in tf:
            m = 100 - 50 + 50 * sum(c.values()) * total // words
            s = sum(w[t] * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, math.inf if i is None else i))
        out += [(item, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("shard,block", [(16384, 1 << 19), (7, 120)])
def test_ranking(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ranked, "SHARD", shard)
    monkeypatch.setattr(ranked, "ITEM_BYTES", block)
    rng = random.Random(shard)
    docs = [(i, prose(rng, rng.choice([1, 5, 40, 300]))) for i in range(150)]
    docs += [(500 + i, docs[3][1]) for i in range(30)] + [(3, docs[3][1]), (None, docs[4][1]), (900, None), (901, ""), (902, "...é ÄÖ ÉcoleX 12a"), (903, "Ünï " * 5000)]
    items = [(i, prose(rng, rng.choice([2, 15, 60]))) for i in range(8)] + [(8, "12A école éCOLEx Ünï"), (9, None), (10, "?"), (11, "zzzzqq"), (0, "the 12a"), (None, docs[3][1])]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(4)
    asked = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int")
    got = Counter(tuple(r) for r in ranked.rank_documents(frame, asked, k=10).collect())
    assert got == brute_ranking(docs, items, 10)
    assert ranked.rank_documents(frame.limit(0), asked, k=10).collect() == []
    assert ranked.rank_documents(frame, asked.limit(0), k=10).collect() == []


def test_best_positions_stop_early():
    """Few documents are looked up where lists are skewed, and what was not looked up scores strictly below the k-th."""
    rng = np.random.default_rng(3)
    n, q = 5000, 4
    impact = (1000 * rng.pareto(1.0, (q, n))).astype(np.int64) + 1
    term, doc = np.divmod(np.arange(q * n), n)
    shard = ranked.Shard(np.arange(n), term, doc, impact.ravel(), q)
    docs, scores, looked = shard.best(np.arange(q), 10, np.zeros(0, np.int64))
    total = impact.sum(axis=0)
    assert (scores == total[docs]).all() and looked < n // 2
    left_out = np.setdiff1d(np.arange(n), docs)
    assert total[left_out].max() < np.sort(scores)[-10]
    assert shard.best(np.arange(q), 10, np.full(10, total.max() + 1))[2] <= 32 * q  # known scores count
    assert shard.best(np.arange(0), 10, np.zeros(0, np.int64))[2] == 0


def brute_negatives(rows, is_anchor, k=5, n=10):
    good = [(i, label, np.array(v, object)) for i, v, label in rows
            if v and label is not None and all(x is not None and abs(x) < negatives.LARGEST for x in v)]
    out = []
    for a, (ident, label, v) in enumerate(good):
        if ident is None or not is_anchor(ident):
            continue
        scored = [(-int(v @ w), math.inf if j is None else j, l) for b, (j, l, w) in enumerate(good) if b != a and len(w) == len(v)]
        best = sorted((s, j) for s, j, l in scored if l == label)[:k]
        for s, j in best:
            low = sorted((x, y) for x, y, l in scored if l != label and 30 * -s <= 100 * -x <= 90 * -s)[:n]
            out += [(ident, None if j == math.inf else j, r, None if y == math.inf else y, -s, -x) for r, (x, y) in enumerate(low, 1)]
    return Counter(out)


@pytest.mark.parametrize("settings", [{}, {"ANCHOR_BYTES": 3000, "SAMPLE": 60, "EXPECTED": 2, "TILE_ANCHORS": 5, "TILE_ROWS": 37, "GROUP": 3}])
def test_negatives(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 24))
    rows = []
    for i in range(500):
        v = centers[rng.integers(6)] * rng.choice([0, 0.4, 1]) + rng.normal(size=24) * 0.5
        rows.append((i, [int(x) for x in np.floor(64 * v * (rng.random(24) < 0.8))], int(rng.integers(0, 4))))
    rows += [(600 + i, rows[10][1], rows[10][2]) for i in range(12)] + [(700 + i, rows[10][1], 9) for i in range(30)]  # ties
    rows += [(20, rows[20][1], rows[20][2]), (None, rows[30][1], 2), (800, None, 1), (801, [], 1), (802, [1, None] * 12, 1), (803, [5] * 24, None),
             (820, [1, 2, 3], 1), (821, [1, 2, 3], 1), (822, [1, 1, 1], 2), (840, [0] * 24, 1), (860, [negatives.LARGEST] * 24, 1),
             (880, [-x for x in rows[10][1]], 77)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<long>, label int, rank int, row int").repartition(4)
    got = negatives.mine_negatives(frame, F.col("vec_id") % 20 == 0)
    assert Counter(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda i: i % 20 == 0)
    assert negatives.mine_negatives(frame.limit(0), F.lit(True)).collect() == []
    assert negatives.mine_negatives(frame, F.lit(False)).collect() == []


def test_pruned_pairs_are_exact():
    rng = np.random.default_rng(6)
    for _ in range(40):
        a = np.floor(rng.normal(size=(9, 21)) * 50 * rng.random(21))
        x = np.floor(rng.normal(size=(50, 21)) * 50 * (rng.random((50, 21)) < 0.7))
        least = np.floor(rng.normal(size=9) * 3000 + 4000)
        allowed = rng.random((9, 50)) < 0.6
        i, j, s = negatives._pairs(a, x, least, allowed)
        want = {(p, q): int(a[p] @ x[q]) for p in range(9) for q in range(50) if allowed[p, q] and a[p] @ x[q] >= least[p]}
        assert dict(zip(zip(i.tolist(), j.tolist()), s.tolist())) == want
