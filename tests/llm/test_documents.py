"""Operators on documents against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilframe.llm import exact, graph, jaccard, language, mixing, packing, passages, scoring, suffixes
from veilframe.llm.common import mix, shingles, utf8, word_hashes
from veilframe.llm.queries import tokenizer_path

VOWELS = ["ka", "lo", "mi", "ru", "te", "so", "na", "vi", "pe", "du", "gah", "zor"]


def prose(rng, n):
    return " ".join("".join(rng.choice(VOWELS) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = prose(rng, 1) + "x"
    return " ".join(words)


def components_of(links, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, ids string, h1 string, sig string, row_key string, Text_Sha256 string, member string, times string"


@pytest.fixture(scope="module")
def awkward(spark):
    long_text = prose(random.Random(5), 60_000)
    rows = [(1, None), (2, ""), (None, "a word"), (None, None), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one"), (6, "é ü 漢字  two  blanks"),
            (7, "aaaaaaaa" * 60), (8, long_text), (9, long_text), (None, long_text), (10, "1234 5678"), (4, "other")]
    return spark.createDataFrame([(i, t, None if i == 2 else "en", None, None, "x", "y", "z", "k", "s", "m", "t") for i, t in rows], AWKWARD)


@pytest.fixture(scope="module")
def profiles(spark):
    rng = random.Random(1)
    rows = [(prose(rng, 40), "en") for _ in range(20)] + [(prose(rng, 40).replace("k", "w").replace("o", "ö"), "de") for _ in range(20)]
    return language.learn_profiles(spark.createDataFrame(rows, "text string, lang string"))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    rows = [(prose(rng, 60), "high") for _ in range(30)] + [(" ".join(["spam"] * 30), "low")] * 30
    return mixing.learn_domains(spark.createDataFrame(rows, "text string, domain string"), buckets=256)


def operators(profiles, model):
    return {
        "pack": (lambda d: packing.pack(d, tokenizer_path()), None),
        "exact": (exact.exact_dedup, 1), "drop_exact": (exact.drop_exact_copies, None),
        "jaccard": (jaccard.jaccard_join, 1), "drop_near": (jaccard.drop_near_copies, None),
        "suffix": (suffixes.remove_repeated_strings, 1), "passages": (passages.passage_dedup, 1),
        "score": (scoring.pseudo_likelihood, 1), "rates": (lambda d: mixing.mix_rates(d, model, {"high": 1.0, "low": 0.1}), 1),
        "mixed": (lambda d: mixing.mix_documents(d, model, {"high": 1.0, "low": 0.1}), None),
        "language": (lambda d: d.select("doc_id", language.language_of(F.col("text"), profiles).alias("l")), 1),
        "reject": (lambda d: language.reject_unidentified(d, profiles), None)}


@pytest.mark.parametrize("name", ["pack", "exact", "drop_exact", "jaccard", "drop_near", "suffix", "passages", "score", "rates",
                                  "mixed", "language", "reject"])
def test_awkward_and_empty_tables(awkward, profiles, model, name):
    run, each = operators(profiles, model)[name]
    rows = run(awkward).collect()
    if each:
        assert len(rows) == awkward.count()
    assert run(awkward.limit(0)).collect() == []
    found = defaultdict(list)
    for r in rows:
        found[r["doc_id"] if "doc_id" in r.asDict() else None].append(r)
    if name == "pack":
        assert Counter((r["doc_id"], r["start"]) for r in rows)[(4, 0)] == 3
        assert found[1][0]["doc_tokens"] == found[2][0]["doc_tokens"] == 1
        assert sum(r["length"] for r in rows) == sum({(r["doc_id"], r["doc_tokens"]): r["doc_tokens"] * sum(
            q["start"] == 0 for q in found[r["doc_id"]] if q["doc_tokens"] == r["doc_tokens"]) for r in rows}.values())
    if name == "exact":
        assert [r["group_size"] for r in found[1]] == [3] and found[1][0]["kept"] and found[5][0]["keep_id"] == 4
        assert found[9][0]["keep_id"] == 8 and {r["keep_id"] for r in found[None]} == {1, 8, None}
    if name == "drop_exact":
        assert Counter(r["text"] for r in rows)["one"] == 1 and len(rows) == 9
        assert len(rows[0]) == len(awkward.columns)
    if name == "drop_near":
        assert Counter(r["text"] for r in rows)["one"] == 1 and {1, 2, 3} <= {r["doc_id"] for r in rows}
    if name == "jaccard":
        assert found[1][0]["n_shingles"] == found[3][0]["n_shingles"] == 0 and found[3][0]["component_id"] == 3
        assert found[5][0]["component_id"] == 4 and found[9][0]["component_id"] == 8
    if name == "suffix":
        assert found[7][0]["kept"] == b"" and found[8][0]["kept"] == b"" and found[1][0]["n_bytes"] == 0
        assert found[6][0]["spans"] == []
    if name == "passages":
        assert found[8][0]["n_repeated"] == found[8][0]["n_words"] == 60_000 and found[8][0]["partners"] == [8]
        assert found[1][0]["spans"] == [] and found[6][0]["n_words"] == 5
    if name == "score":
        assert found[1][0]["n_tokens"] == 0 and found[1][0]["log_likelihood"] == 0
        assert found[8][0]["log_likelihood"] == pytest.approx(found[9][0]["log_likelihood"]) and found[8][0]["log_likelihood"] < 0
    if name == "language":
        assert {r["l"]["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 10)} == {"und"}
    if name == "reject":
        assert {r["doc_id"] for r in rows} == {None, 4, 5, 6, 7, 8, 9} and list(rows[0].asDict()) == awkward.columns


def test_components_over_many_tasks(spark):
    rng = random.Random(1)
    for n, m, chunk in ((120, 60, 9), (120, 200, 15), (80, 79, 5)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != n - 1 else [(i, i + 1) for i in range(m)]
        want = components_of(edges, {x for e in edges for x in e})
        got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(4), chunk).collect()}
        assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup_over_rounds(spark, keep):
    rng = random.Random(3)
    texts = [prose(rng, 3) for _ in range(30)]
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(texts)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(70)  # three rounds of eight
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    pick = min if keep == "smallest" else max
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact.exact_dedup(docs, keep=keep).collect()}
    assert got == {i: (pick(groups[t]), len(groups[t]), i == pick(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}


def test_digest_blocks_merge_in_bounded_pieces():
    rng = np.random.default_rng(1)
    runs = []
    for _ in range(20):
        run = np.zeros((5000, 8), np.uint64)
        run[:, :4] = rng.integers(0, 4, (5000, 4))
        run[:, 7] = 1
        runs.append(exact._sorted_fold(run, False))
    blocks = sorted((r[i:i + 50] for r in runs for i in range(0, len(r), 50)), key=lambda b: tuple(b[0][:4]))
    batch = exact._block_batch([(0, b) for b in blocks])
    out = list(exact._merge(1, 1, False)(iter([batch])))
    assert sum(sum(b.column("group_size").to_pylist()) for b in out) == 20 * 5000
    keys = [k for b in out for k in b.column("sha").to_pylist()]
    assert keys == sorted(set(keys)) and len(out) > 1


def brute_links(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if sets[a] and
             100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[a] & sets[b]]
    return sets, components_of(links, ids)


@pytest.mark.parametrize("size,percent,leaf", [(3, 90, 256), (5, 80, 256), (5, 80, 7), (3, 90, 5), (2, 60, 256)])
def test_jaccard_join_is_whole(spark, monkeypatch, size, percent, leaf):
    monkeypatch.setattr(jaccard, "LEAF", leaf)  # small leaves: many pages, a hub, and what it leaves over
    rng = random.Random(size * percent + leaf)
    docs = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    base, shared = prose(rng, 90), prose(rng, 60)
    docs += [edited(rng, base, rng.randint(0, 8)) for _ in range(40)]
    docs += [prose(rng, 40) + " " + shared + " " + prose(rng, 40) for _ in range(15)]
    docs += [edited(rng, t, 1) for t in docs[:30]] + ["a b c d e f g h i j", "a b c d e f g h i j k", "A b C d e f g h i j", ""]
    rows = list(enumerate(docs))
    sets, want = brute_links(rows, size, percent)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(frame, size=size, percent=percent).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in want}
    kept = {r["doc_id"] for r in jaccard.drop_near_copies(frame, size=size, percent=percent).collect()}
    assert kept == {i for i in want if want[i] == i or not sets[i]}


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(4)
    for percent in (60, 80, 90, 95):
        rule = jaccard.Rule(3, percent)
        for n in [*range(1, 60), 100, 127, 128, 140, 255, 300, 511, 700]:
            a = np.unique(mix(rng.integers(0, 1 << 62, n).astype(np.uint64)))
            lose = int(rng.integers(0, rule.differ(n) + 1))
            b = np.concatenate([a[lose:], mix(rng.integers(0, 1 << 62, int(rng.integers(0, rule.differ(n) + 1 - lose))).astype(np.uint64))])
            b = np.unique(b)
            both = len(np.intersect1d(a, b))
            if len(a) != len(b) or both != len(a):
                if both and 100 * both >= percent * (len(a) + len(b) - both):
                    assert len(np.intersect1d(jaccard.part_keys(a, rule), jaccard.part_keys(b, rule))), (percent, n, lose)


def test_word_hashes_and_shingles():
    texts = ["The  cat\tSAT on the mat", "", "the cat sat ON the mat", "x", None, " é\x0bü "]
    data, bounds = utf8(pa.array(texts))
    words, at = word_hashes(data, bounds)
    assert np.diff(at).tolist() == [6, 0, 6, 1, 0, 2]
    assert words[at[0]:at[1]].tolist() == words[at[2]:at[3]].tolist() and words[0] == words[4]
    codes, limits = shingles(words, at, 3, whole=True)
    assert np.diff(limits).tolist() == [4, 0, 4, 1, 0, 1] and len(set(codes.tolist())) == 6


def brute_repeats(texts):
    seen = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                cover[i:i + 200] = b"\1" * 200
        out.append(bytes(cover))
    return out


@pytest.mark.parametrize("wide", [20_000, 2])
def test_repeated_strings(spark, monkeypatch, wide):
    monkeypatch.setattr(suffixes, "WIDE", wide)  # at 2, common leading bytes go by whole strings
    rng = random.Random(wide)
    block = [prose(rng, 60) for _ in range(4)]
    texts = [prose(rng, rng.randint(1, 90)) for _ in range(15)]
    texts += [prose(rng, rng.randint(0, 30)) + block[rng.randrange(4)][rng.randrange(60):rng.randrange(250, 330)] + prose(rng, 20) for _ in range(25)]
    texts += [texts[0] * 3, "ab" * 300, "a" * 199, "a" * 200, "é" * 150, block[0], block[0], "x" + block[1] + block[1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    raw = [t.encode() for t in texts]
    covers = brute_repeats(raw)
    for r in suffixes.remove_repeated_strings(docs).collect():
        cover, text = covers[r["doc_id"]], raw[r["doc_id"]]
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", cover)]
        assert [(s["start"], s["end"]) for s in r["spans"]] == spans, r["doc_id"]
        assert bytes(r["kept"]) == bytes(x for x, c in zip(text, cover) if not c) and r["n_bytes"] == len(text)


def test_long_texts_are_cut_with_overlap(monkeypatch):
    rng = random.Random(9)
    text = prose(rng, 900).encode()
    data = np.frombuffer(text, np.uint8)
    whole = [set(range(f, l + 1)) for f, l in zip(*suffixes.anchored_runs(data, np.array([0, len(data)]))[1:3])]
    monkeypatch.setattr(suffixes, "_SPAN", 700)
    parts = list(suffixes._segments(data, np.array([0, len(data)])))
    assert len(parts) > 3
    starts = [f + s + i for _, d, b, s in parts for f, l in zip(*suffixes.anchored_runs(d, b)[1:3]) for i in range(l - f + 1)]
    assert sorted(starts) == list(range(len(text) - 199)) == sorted(x for w in whole for x in w)


def test_a_bucket_may_hold_one_suffix():
    row = pa.table({"lead": [b"a" * suffixes.LEAD], "before": [b"xy"], "after": [b"b" * 5], "band": pa.array([1], pa.int32()),
                    "least": pa.array([26], pa.int32()), "most": pa.array([28], pa.int32())})
    assert suffixes.repeated_masks(row).tolist() == [0]
    pair = pa.concat_tables([row, row])
    assert suffixes.repeated_masks(pair).tolist() == [0b111 << 26] * 2


def test_multikey_sort():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    order = suffixes.multikey_sort(words)
    assert [tuple(w) for w in words[order]] == sorted(tuple(w) for w in words)


def test_windows_are_cartesian_tree_nodes():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    bounds = np.array([0, 120, 125, 300])
    a, c, b, value = passages.compact_windows(codes, bounds, 20, 77)
    hashed = mix(codes ^ np.uint64(77))
    want = []
    for x, y in zip(bounds[:-1], bounds[1:]):
        for i in range(x, y):  # the span of the node of i in the Cartesian tree of its text
            left = i
            while left > x and hashed[left - 1] >> np.uint64(24) > hashed[i] >> np.uint64(24):
                left -= 1
            right = i
            while right + 1 < y and hashed[right + 1] >> np.uint64(24) >= hashed[i] >> np.uint64(24):
                right += 1
            if right - left + 1 >= 20:
                want.append((max(left, i - 19), i, min(right, i + 19)))  # a passage's length to either side
    assert sorted(zip(a.tolist(), c.tolist(), b.tolist())) == want and (value == hashed[c]).all()


def test_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(11)
    shared, near = prose(rng, 60), prose(rng, 120)
    texts = [prose(rng, 200) for _ in range(20)]
    texts += [prose(rng, 70) + " " + shared + " " + prose(rng, 70) for _ in range(6)]
    texts += [prose(rng, 50) + " " + edited(rng, near, 1) + " " + prose(rng, 50) for _ in range(5)]
    texts += [prose(rng, 40) + " " + prose(random.Random(5), 30) for _ in range(4)]  # shared, but too short
    rows = {r["doc_id"]: r for r in passages.passage_dedup(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i in range(20, 26):
        assert any(s["start"] <= 70 and s["end"] >= 130 for s in rows[i]["spans"]) and rows[i]["component_id"] == 20
        assert sum(s["end"] - s["start"] for s in rows[i]["spans"]) < 90
    for i in range(26, 31):
        assert sum(s["end"] - s["start"] for s in rows[i]["spans"]) >= 100 and rows[i]["component_id"] == 26 and rows[i]["partners"]
    assert all(not rows[i]["spans"] and rows[i]["component_id"] == i for i in [*range(20), *range(31, 35)])


def inserted(rng, text, places, cut=0):
    words = text.split(" ")
    for at in sorted(places, reverse=True):
        words[at:at + cut] = [] if cut else [prose(rng, 1) + "x"]
    return " ".join(words)


def test_passages_of_repeated_lines_that_share_few_shingles_are_settled_quickly():
    """Two texts of repeated lines with few shingles in common met at many places; each had thousands of ranges to judge."""
    left, right = np.zeros(260, np.uint64), np.zeros(600, np.uint64)
    left[::7], right[::8] = np.arange(1, 39), np.arange(51, 126)
    at = [(r, w) for w in range(301, 400, 9) for r in range(101, 200, 9) if r % 7 and w % 8]
    windows = np.array([(f, r - 45, r, r + 45, w - 45, w, w + 45) for r, w in at for f in (0, 1)]).T
    began = time.perf_counter()
    assert passages.verified_ranges(left, right, windows, False) == []
    assert time.perf_counter() - began < 2


def test_ranges_of_repeated_lines_are_judged_as_one_by_one():
    rng = np.random.default_rng(5)
    for _ in range(30):
        x, y = (rng.integers(0, int(rng.integers(2, 50)), int(rng.integers(60, 200))).astype(np.uint64) for _ in range(2))
        span = passages._SPAN
        assert passages._variety(x).tolist() == [len(set(x[i:i + span].tolist())) for i in range(len(x) - span + 1)]
        a, c = rng.integers(0, len(x) - span, 50), rng.integers(0, len(y) - span, 50)
        b, e = a + span, c + span
        alike = [passages._jaccard(x[i:j], y[k:n]) for i, j, k, n in zip(a, b, c, e)]
        assert passages._Sets(x, y).first_alike(a, b, c, e) == (alike.index(True) if any(alike) else -1)


def test_chains_are_those_of_all_comparisons_and_long_ones_are_quick():
    def plain(x, y, u, v):
        met, lo, hi = y - x, u.copy(), v.copy()
        for r in range(1, len(x)):
            low, high, m = np.minimum(lo[:r], u[r]), np.maximum(hi[:r], v[r]), met[:r] + y[r] - x[r]
            q = int(((100 + passages.PERCENT) * m - passages.PERCENT * (high - low)).argmax())
            met[r], lo[r], hi[r] = m[q], low[q], high[q]
        return met, lo, hi

    rng = np.random.default_rng(8)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        size, gap = rng.integers(1, 9, n), rng.integers(0, 4, n)
        x = np.cumsum(size + gap) - size
        u = x + rng.choice([0, int(rng.integers(-300, 300)), int(rng.integers(-20, 20))], n)
        for step in (1, -1):
            runs = [c[::step] for c in (x, x + size, u, u + size)]
            assert [c.tolist() for c in passages._chains(*runs)] == [c.tolist() for c in plain(*runs)]
    x = np.arange(0, 360_000, 4)
    began = time.perf_counter()
    assert passages._chains(x, x + 3, x, x + 3)[0][-1] == 270_000
    assert time.perf_counter() - began < 5


def test_windows_are_packed_and_unpacked_and_finished_writes_leave_no_shuffles_setting(spark):
    from veilframe.session import _CLEANUP, shuffles_given_back

    rng = np.random.default_rng(9)
    context, h1 = (rng.integers(-(1 << 63), 1 << 63, 500) for _ in range(2))
    h2, c, left, right = rng.integers(-(1 << 31), 1 << 31, 500), rng.integers(45, 1 << 40, 500), rng.integers(0, 46, 500), rng.integers(0, 46, 500)
    x, y = passages._named(context, h1, h2)
    assert all((a == b).all() for a, b in zip(passages._names(x, y), (h1, h2)))
    assert (x >> 32 == context >> 32).all() and (np.argsort(x) == np.lexsort((h1 >> 32, context >> 32))).all()
    for f in range(passages.FUNCTIONS):
        assert all((a == b).all() for a, b in zip(passages._places(passages._placed(f, c - left, c, c + right)), (f, c - left, c, c + right)))
    before = spark.conf.get(_CLEANUP, None)
    with shuffles_given_back(spark):
        assert spark.conf.get(_CLEANUP) == "true"
    assert spark.conf.get(_CLEANUP, None) == before


def test_passages_over_inserted_deleted_and_moved_words(spark):
    rng = random.Random(12)
    base = [prose(rng, 60), prose(rng, 120), prose(rng, 62), prose(rng, 80), prose(rng, 300)]
    halves = base[3].split(" ")
    pairs = [(base[0], inserted(rng, base[0], [30])), (base[1], inserted(rng, base[1], [40, 80])), (base[2], inserted(rng, base[2], [30], 1)),
             (base[3], " ".join(halves[40:] + halves[:40])), (base[4], inserted(rng, base[4], [60, 150, 155, 240], 2))]
    texts = [prose(rng, 60) + " " + p + " " + prose(rng, 60) for pair in pairs for p in pair]

    def codes(text):
        return shingles(*word_hashes(*utf8(pa.array([text]))), 5, whole=False)[0]

    rows = {r["doc_id"]: r for r in passages.passage_dedup(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for n, pair in enumerate(pairs):
        x, y = (set(codes(p).tolist()) for p in pair)
        assert len(x & y) >= 0.8 * len(x | y)
        for i in (0, 1):
            r = rows[2 * n + i]
            size = len(pair[i].split(" "))
            assert r["partners"] == [2 * n + 1 - i] and r["component_id"] == 2 * n
            assert any(s["start"] <= 65 and s["end"] >= 55 + size for s in r["spans"]) and r["n_repeated"] < size * 1.3


@pytest.mark.parametrize("seed", range(4))
def test_verified_ranges_against_all_ranges(seed):
    """Two texts with inserted and left out words: some range pair around the met place exists if and only if one is found."""
    rng = random.Random(seed)
    span = passages._SPAN
    for edits in (1, 2, 2, 3, 6):
        base = prose(rng, 56)
        other = base
        for _ in range(edits):
            other = inserted(rng, other, [rng.randrange(5, 50)], rng.choice([0, 1]))
        x, y = (shingles(*word_hashes(*utf8(pa.array([prose(rng, 6) + " " + t + " " + prose(rng, 6)]))), 5, whole=False)[0] for t in (base, other))
        here = [(i, j) for i in range(len(x)) for j in range(len(y)) if x[i] == y[j]]
        i, j = here[len(here) // 2]
        want = any(passages._jaccard(x[a:b], y[c:d]) for a in range(i + 1) for b in range(max(i + 1, a + span), len(x) + 1)
                   for c in range(max(0, a - 8), min(j + 1, a + 9)) for d in range(max(j + 1, c + span), len(y) + 1)
                   if 100 * min(b - a, d - c) >= 80 * max(b - a, d - c))
        windows = np.array([[f, max(0, i - 40), i, min(len(x) - 1, i + 40), max(0, j - 40), j, min(len(y) - 1, j + 40)] for f in range(4)]).T
        got = passages.verified_ranges(x, y, windows, False)
        assert bool(got) == want and all(passages._jaccard(x[a:b], y[c:d]) and min(b - a, d - c) >= span for a, b, c, d in got)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = language.learn_profiles(docs.where(~language.held_out()))
    found = docs.where(language.held_out()).select("lang", "text", language.language_of(F.col("text"), profiles).alias("l"))
    rows = found.collect()
    assert all(r["l"]["lang_pred"] == r["lang"] for r in rows if len(r["text"]) > 40)
    assert all(0 <= r["l"]["score"] <= 1 for r in rows)
    crc = {r["doc_id"]: r["h"] for r in docs.select("doc_id", language.held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in crc.items())


def test_bundles_are_sums_of_bound_letters():
    vectors, known = language.bundles(["Abca", "abca!", "", "...", "ab"], 256)
    letters = {c: language.letter_vectors(np.array([ord(c) if c != " " else 0]), 256)[0].astype(int) for c in "abc "}
    want = sum(np.roll(letters[x], 2) * np.roll(letters[y], 1) * letters[z] for x, y, z in ("abc", "bca", "ca "))
    assert known.tolist() == [True, True, False, False, True]
    assert np.allclose(vectors[0], want / np.linalg.norm(want), atol=1e-6) and np.allclose(vectors[0], vectors[1])


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    rng = random.Random(6)
    texts = [prose(rng, rng.choice([0, 3, 40, 300, 1500])) for _ in range(300)] + [" a\n\n b \n c", "x  \n y", "<|endoftext|> z ", "'s don't  'll", "tab\t a\t\tb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    pieces = packing.pack(docs, tokenizer_path())
    rows = pieces.collect()
    ids = defaultdict(dict)
    for r in rows:
        ids[r["doc_id"]][r["start"]] = np.frombuffer(r["ids"], "<u4")
        assert len(r["ids"]) == 4 * r["length"] and r["offset"] + r["length"] <= 1024
    for i, t in enumerate(texts):
        joined = np.concatenate([x for _, x in sorted(ids[i].items())])
        assert joined.tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [0]
    packed = packing.sequences(pieces).collect()
    total = sum(r["length"] for r in rows)
    assert sum(len(s["ids"]) // 4 for s in packed) == total
    assert total / (1024 * len(packed)) > 0.97
    for s in packed:
        at = 0
        for p in s["pieces"]:
            assert p["offset"] == at
            at += p["length"]


def test_column_generation_reaches_known_optima():
    lengths, demand = np.array([300, 400, 624, 724]), np.array([100.0, 60, 60, 100])
    patterns, used = packing.solve_patterns(lengths, demand, 1024)
    assert abs(used.sum() - 160) < 1e-6 and (patterns @ used >= demand - 1e-6).all() and (lengths @ patterns <= 1024).all()
    lengths, demand = np.array([340, 341, 342, 700]), np.array([50.0, 50, 50, 20])
    patterns, used = packing.solve_patterns(lengths, demand, 1024)
    assert used.sum() < 20 + (150 - 0) / 3 + 1  # three short ones fill a sequence
    value, counts = packing.best_pattern(np.array([3, 5]), np.array([1.0, 2.0]), 11)
    assert value == 4.0 and counts.tolist() == [0, 2]


def test_every_tail_has_one_place():
    rng = random.Random(8)
    histogram = {rng.randrange(1, 1024): rng.randrange(1, 400) for _ in range(200)} | {700: 5000}
    plan = packing.plan_tails(histogram)
    length = np.repeat(list(histogram), list(histogram.values()))
    rank = np.concatenate([np.arange(n) for n in histogram.values()])
    sequence, offset = plan.place(length, rank)
    taken = defaultdict(list)
    for s, o, n in zip(sequence.tolist(), offset.tolist(), length.tolist()):
        first = min(n, 1024 - o)
        taken[s].append((o, first))
        if first < n:
            taken[s + 1].append((0, n - first))
    short = 0
    for spans in taken.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        short += at < 1024 - packing.SLACK
    assert short <= 1


def test_gradient_and_scores_of_the_network(spark):
    network = scoring.Network.start(3)
    rng = np.random.default_rng(0)
    data, bounds = utf8(pa.array(["abca", "", "xyz"]))
    codes = scoring.windows(data, bounds)
    symbols = scoring._symbols(codes)
    assert symbols[0].tolist() == [256, 256, 97, 98, 99] and symbols[4].tolist() == [256, 256, 120, 121, 122]
    weight = np.ones(len(codes))
    gradient = network.gradient(symbols, weight)

    def loss(flat):
        return -scoring.Network(flat).log_probabilities(codes).mean()

    for i in rng.choice(np.flatnonzero(np.abs(gradient) > 1e-3), 12):
        step = np.zeros(len(gradient))
        step[i] = 1e-4
        slope = (loss(network.flat.astype(float) + step) - loss(network.flat.astype(float) - step)) / 2e-4
        assert abs(slope - gradient[i]) < 1e-3
    texts = ["the cat sat on the mat " * 20, "the mat sat on the cat " * 20, "zq#x@ " * 10, "the cat sat on the mat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    trained = scoring.train(scoring.window_counts(docs, "text"), rounds=40)
    rows = {r["doc_id"]: r for r in docs.select("doc_id", scoring.score_of(F.col("text"), trained).alias("s")).select("doc_id", "s.*").collect()}
    for i, t in enumerate(texts):
        d, b = utf8(pa.array([t]))
        assert abs(rows[i]["log_likelihood"] - trained.log_probabilities(scoring.windows(d, b)).sum()) < 1e-2
    assert rows[0]["per_token"] > rows[2]["per_token"] and rows[0]["per_token"] > loss(network.flat) * -1
    counts = {r["code"]: r["n"] for r in scoring.window_counts(docs, "text").collect()}
    d, b = utf8(pa.array(texts))
    assert counts == Counter(scoring.windows(d, b).view(np.int64).tolist())


def test_rates_match_a_plain_projected_gradient(spark, model):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(5, 80)) if i % 4 else " ".join(["spam"] * 40)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = mixing.mix_rates(docs, model, {"high": 0.9, "low": 0.1}).collect()
    tokens = np.array([r["n_tokens"] for r in got], float)
    p = np.array([r["posterior"] for r in got])
    rate = np.array([r["rate"] for r in got])
    share = tokens / tokens.sum()
    target = np.array([{"high": 0.9, "low": 0.1}[d] for d in model.domains])
    w = np.ones(len(got))
    step = 1 / (np.linalg.eigvalsh((p.T * share) @ p).max() + 1e-3)
    for _ in range(3000):
        w = np.maximum(0, w - step * (p @ ((share * w) @ p - target) + 1e-3 * (w - 1)))
    assert np.abs((share * rate) @ p - target).max() < 5e-3 and np.abs(rate - w).max() < 0.05
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in got)
    mixed = Counter(r["doc_id"] for r in mixing.mix_documents(docs, model, {"high": 0.9, "low": 0.1}).collect())
    assert mixed == {r["doc_id"]: r["copies"] for r in got if r["copies"]}


@pytest.mark.parametrize("share,target", [(0.0005, 0.02), (0.001, 0.10), (0.3, 0.3)])
def test_rare_domains_reach_their_targets(spark, share, target):
    """A domain of 0.05 % of the tokens is brought to within 5 % of a target forty times its size."""
    rng = np.random.default_rng(5)
    n = 20_000
    rare = rng.random(n) < share
    rare[:5] = True
    sure = rng.uniform(0.85, 0.99, n)
    other = rng.uniform(0, 1, n)
    posterior = np.where(rare[:, None], np.c_[sure, (1 - sure) * other, (1 - sure) * (1 - other)],
                         np.c_[share * 0.02 * other, other, 1 - other - share * 0.02 * other])
    rows = [(int(t), p.tolist()) for t, p in zip(rng.integers(1, 400, n), posterior)]
    members = spark.createDataFrame(rows, "n_tokens long, posterior array<double>").repartition(4)
    targets = {"a": target, "b": 0.7 * (1 - target), "c": 0.3 * (1 - target)}
    descent = mixing.fit_rates(members, ("a", "b", "c"), targets)
    rated = members.withColumn("rate", mixing.rate_of(F.col("posterior"), descent))
    for row in mixing.expected_totals(rated, ("a", "b", "c"), targets).collect():
        assert row["expected_tokens"] == pytest.approx(row["target_tokens"], rel=0.05), row


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SHARD_WINDOWS", 1500)
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, prose(rng, 60)) for i in range(80)], "doc_id long, text string")

    def scores(frame):
        return {r["doc_id"]: r["per_token"] for r in scoring.pseudo_likelihood(frame).collect()}

    one, other = scores(docs.coalesce(1)), scores(docs.repartition(7).orderBy(F.desc("doc_id")))
    assert max(abs(one[i] - other[i]) for i in one) < 1e-3


def test_copies_of_a_text_are_drawn_one_by_one(spark):
    rows = [(i, "der hund und die katze", "de") for i in range(3000)] + [(9000 + i, f"the dog and the cat {i}", "en") for i in range(50)]
    learned = language.learn_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=100)
    assert learned.languages == ("de", "en")
