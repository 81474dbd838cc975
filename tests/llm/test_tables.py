"""Embeddings, archives and the pipeline against brute force."""

from __future__ import annotations

import gzip
import hashlib
import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from veilframe.llm import embeddings, warc
from veilframe.session import shared_folder

sys.path.insert(0, os.path.dirname(__file__))
from test_documents import brute_links, components_of, edited, prose  # noqa: E402


def brute_cosine(rows):
    good = {}
    for i, (ident, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links = [(a, b) for a in good for b in good if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b])
             and good[a] @ good[b] >= 0.93]
    return Counter(x for p in links for x in p), components_of(links, range(len(rows)))


@pytest.mark.parametrize("small,chunk", [(64, 512), (3, 6)])
def test_embeddings(spark, monkeypatch, small, chunk):
    monkeypatch.setattr(embeddings, "SMALL", small)  # buckets over it are multiplied in chunks
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    rng = np.random.default_rng(small)
    rows = []
    for c in range(12):
        center = rng.normal(size=64)
        for _ in range(rng.integers(1, 14)):
            rows.append((center + rng.normal(size=64) * rng.choice([0.05, 0.2]), int(c % 2)))
    rows += [(rng.normal(size=64), int(rng.integers(0, 2))) for _ in range(150)] + [(rows[0][0], 0)] * 4 + [(rows[0][0] * 3, 0), (rows[0][0], 1)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    rows += [(1000, None, 0), (1001, [0.0] * 64, 0), (1002, [float("nan")] + [1.0] * 63, 0), (1003, [1.0] * 64, None), (1004, [], 0),
             (1005, [1.0, 2.0], 0), (1006, [2.0, 4.0], 0), (1007, [None] * 64, 1), (1008, [-0.0, 1.0], 1), (1009, [0.0, 1.0], 1)]
    links, root = brute_cosine(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r["vec_id"]: r for r in embeddings.embedding_dedup(frame).collect()}
    assert len(got) == len(rows)
    for place, (i, _, _) in enumerate(rows):
        assert got[i]["n_links"] == links[place] and got[i]["component_id"] == rows[root[place]][0], i
        assert got[i]["kept"] == (got[i]["component_id"] == i)
    assert embeddings.embedding_dedup(frame.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, [1.0, 0.0], 1, 5), (7, [1.0, 0.0], 1, 5), (7, [1.0, 0.0], 1, 6)], "vec_id long, embedding array<double>, label int, cid int")
    assert [(r["n_links"], r["component_id"]) for r in embeddings.embedding_dedup(odd).collect()] == [(2, 7)] * 3


def test_first_meeting_is_in_a_shared_bucket():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = rng.integers(0, 1 << 16, (1, 4)).astype(np.uint64)
        y = x ^ np.array([[sum(1 << int(b) for b in rng.choice(16, rng.integers(0, 5), replace=False)) for _ in range(4)]], np.uint64)
        table, key = embeddings._canonical(x, y)
        balls = [{(j, int(v[0, j]) ^ m) for j in range(4) for m in [0, *(1 << i for i in range(16))]} for v in (x, y)]
        both = balls[0] & balls[1]
        assert (int(table[0]), int(key[0])) == (min(both) if both else (-1, 0))


def with_common_direction(rng, n, dim, mean_cosine):
    base = rng.normal(size=dim)
    base /= np.linalg.norm(base)
    v = rng.normal(size=(n, dim)) / np.sqrt(dim)
    return np.sqrt(mean_cosine) * base + np.sqrt(1 - mean_cosine) * v


@pytest.mark.parametrize("dim", [64, 128, 768])
@pytest.mark.parametrize("mean_cosine", [0.0, 0.7, 0.8])
def test_recall_of_the_index(dim, mean_cosine):
    """Pairs of cosine 0.93 to 0.97 meet, also where all vectors share a direction. Brute force over 2,000 made pairs."""
    rng = np.random.default_rng(dim)
    unit = with_common_direction(rng, 6000, dim, mean_cosine)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    coder = embeddings.choose_coder(unit[:4000], 0.93, 1e6, 1e10)
    here, noise = unit[4000:], rng.normal(size=(2000, dim))
    noise -= (noise * here).sum(axis=1, keepdims=True) * here
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.uniform(0.93, 0.97, (2000, 1))
    there = cosine * here + np.sqrt(1 - cosine**2) * noise
    x, y = coder.parts(here), coder.parts(there)
    met = embeddings._meet(x, y) & (np.bitwise_count(x ^ y).sum(axis=1) <= coder.radius)
    assert met.mean() >= 0.97, (met.mean(), coder.width, coder.tables, coder.recall)


def test_links_with_a_common_direction(spark):
    rng = np.random.default_rng(9)
    v = with_common_direction(rng, 400, 32, 0.8)
    v = np.concatenate([v, v[:150] + rng.normal(size=(150, 32)) * 0.045])
    rows = [(i, [float(np.float32(x)) for x in r], i % 2) for i, r in enumerate(v)]
    links, _ = brute_cosine(rows)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert sum(got.values()) >= 0.97 * sum(links.values()) > 100 and all(got[i] <= links[i] for i in got)


@pytest.fixture
def pages(spark):
    html = "<p>" + "long page " * 150
    rows = [(1, "http://a", html), (2, "http://b", html), (3, "http://c\nx", html), (4, None, "short"), (5, "u", "short"), (6, "u", None),
            (7, "u", ""), (None, "u", html), (8, "u", "é" * 600), (9, "u", "é" * 600), (10, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, key string, n int")


def test_archive_round_trip(spark, pages):
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages, shared_folder(spark, "warc")).collect()}
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    assert set(got) == set(html)
    first = {1: 3, 2: 3, 8: 9, None: 3}
    for i, payload in html.items():
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", first[i]) if i in first else ("response", None))
    assert warc.archive_round_trip(pages.limit(0), shared_folder(spark, "warc")).collect() == []


def record(number, payload):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{number}>\r\nContent-Type: application/http\r\n"
            f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(packed):
    rng = random.Random(packed)
    payloads = [prose(rng, 80).encode() + b"\r\nWARC/1.1\r\n\x1f\x8b\x08" + bytes(rng.randrange(256) for _ in range(50)) for _ in range(12)]
    parts = [record(i, p) for i, p in enumerate(payloads)]
    parts = [gzip.compress(x, mtime=0) for x in parts] if packed else parts
    clean = list(warc.salvage(b"".join(parts)))
    assert [r[2]["payload"] for r in clean] == payloads and [r[0] for r in clean] == [sum(map(len, parts[:i])) for i in range(12)]
    hurt = list(parts)
    hurt[2] = hurt[2][:-40]  # bytes lost
    hurt[5] = hurt[5][:-60] + bytes([hurt[5][-60] ^ 1]) + hurt[5][-59:]  # a bit turned
    hurt[8] = b"junk" + hurt[8]
    hurt[11] = hurt[11][:60]
    data = b"".join(hurt)
    out = list(warc.salvage(data))
    assert [r[2]["payload"] for r in out if r[2]] == [p for i, p in enumerate(payloads) if i not in (2, 5, 11)]
    gaps = [(o, n, why) for o, n, r, why in out if r is None]
    start = [sum(map(len, hurt[:i])) for i in range(13)]
    assert [(o, n) for o, n, _ in gaps] == [(start[2], len(hurt[2])), (start[5], len(hurt[5])), (start[8], 4), (start[11], len(hurt[11]))]
    assert all(why for _, _, why in gaps) and sum(n for _, n, *_ in out) == len(data)
    assert list(warc.salvage(b"")) == [] and [r[2] for r in warc.salvage(os.urandom(500))] == [None]


def test_salvage_inside_members():
    """Records of one member: bytes lost at its end, a damaged record before a sound compression, a flipped check sum."""
    rng = random.Random(4)
    payloads = [prose(rng, 60).encode() for _ in range(50)]
    parts = [record(i, p) for i, p in enumerate(payloads)]
    whole = gzip.compress(b"".join(parts), mtime=0)
    tail = gzip.compress(record(99, b"next"), mtime=0)

    def read(data):
        out = list(warc.salvage(data))
        return [r[2]["payload"] for r in out if r[2]], [(o, n, why) for o, n, r, why in out if r is None]

    assert read(whole + tail) == (payloads + [b"next"], [])
    got, gaps = read(whole[:-20] + tail)  # the end is lost: nearly all records inflate
    assert got[:-1] == payloads[:len(got) - 1] and len(got) >= 49 and got[-1] == b"next"
    assert [(o, n) for o, n, _ in gaps] == [(0, len(whole) - 20)]
    hurt = list(parts)
    hurt[7] = hurt[7][:-30] + b"#" + hurt[7][-29:]
    hurt[8] = hurt[8][:-9]
    got, gaps = read(gzip.compress(b"".join(hurt), mtime=0) + tail)
    assert got == [p for i, p in enumerate(payloads) if i not in (7, 8)] + [b"next"] and len(gaps) == 1
    start, stop = sum(map(len, hurt[:7])), sum(map(len, hurt[:9]))
    assert gaps[0][0] == 0 and gaps[0][2].endswith(f"{start}-{stop}")
    got, gaps = read(whole[:-6] + bytes([whole[-6] ^ 1]) + whole[-5:] + tail)
    assert got == payloads + [b"next"] and [(o, n) for o, n, _ in gaps] == [(0, len(whole))]


def test_gaps_are_logged(spark, tmp_path):
    parts = [record(i, prose(random.Random(i), 30).encode()) for i in range(4)]
    (tmp_path / "a.warc").write_bytes(parts[0] + parts[1][:-9] + parts[2])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(parts[3]))
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted(r["record_id"] for r in rows if r["kind"] == "record") == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>"]
    gap, = [r for r in rows if r["kind"] == "gap"]
    assert (gap["offset"], gap["length"]) == (len(parts[0]), len(parts[1]) - 9) and gap["reason"]


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(12)
    texts = [prose(rng, 60) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i], "en", "s", 1) for i in range(5)] + [(200 + i, edited(rng, texts[i + 10], 1), "en", "s", 1) for i in range(5)]
    rows += [(300, "123 456", None, None, None), (301, None, None, None, None), (302, "", "en", None, None), (0, texts[0], "en", "s", 1)]
    rows += [(400 + i, " ".join(["idiot trash"] * 20) + " " + prose(rng, 30), "en", "s", 1) for i in range(10)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(400 + i, 1, 1) for i in range(6)] + [(None, 1, None)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
    everyone = [r[0] for r in rows]
    assert kept[0] == sorted(i for i in everyone if i not in (300, 301, 302))
    largest = {}
    for i, t, *_ in rows:
        largest[t] = max(i, largest.get(t, -1))
    assert kept[1] == sorted(i for t, i in largest.items() if i not in (300, 301, 302))
    sets, root = brute_links([(i, t) for t, i in largest.items() if i in kept[1]], 5, 80)
    assert kept[2] == sorted(i for i in root if root[i] == i)
    mixed = Counter(kept[3])
    assert set(mixed) <= set(kept[2]) and all(mixed[i] >= 1 for i in kept[2] if i < 300)  # clean ones stay
    assert sum(mixed[i] for i in range(400, 410)) < 10
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in pieces} == set(mixed)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r["doc_id"], r["start"], r["ids"]) for r in whole.collect()) == sorted((r["doc_id"], r["start"], r["ids"]) for r in pieces)
    empty = spark.createDataFrame([], kinds)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_library_stands_without_this_subpackage():
    code = ("import sys\nclass No:\n    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith('veilframe.llm') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nq = e.queries()\n"
            "assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q and e.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.join(os.path.dirname(__file__), "..", ".."))
