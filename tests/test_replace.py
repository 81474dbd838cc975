"""Dictionary replacement, restoring and the vault against brute force."""

from __future__ import annotations

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import model
from veilframe.functions.text import vault_token
from veilframe.operators.mask import mask_as_of, mask_everywhere
from veilframe.operators.replace import _Prefixes, replace_scoped
from veilframe.operators.restore import restore, restore_ansi
from veilframe.operators.vault import assign_tokens, build_vault, name_conflicts, require_unique_names, rehydrate_vault
from veilframe.streaming.cutters import Dictionary, TokenHold

RANDOM = random.Random(11)


def word(lo, hi, alphabet="ab.\\E(é😀 "):
    return "".join(RANDOM.choices(alphabet, k=RANDOM.randint(lo, hi)))


@pytest.mark.parametrize("map_rules", [0, 1 << 20, 3])
def test_scoped_replacement(spark, map_rules):
    """``map_rules`` 0 sends every scope through the search, a large one through maps, 3 mixes both."""
    texts = [(i, i % 5, word(0, 60)) for i in range(300)] + [(300, 9, "no rules"), (301, 1, None)]
    rules = {s: {word(1, 4): f"<{i}>" for i in range(1 + s)} for s in range(5)}
    df = spark.createDataFrame(texts, "id int, scope int, text string").repartition(4)
    flat = spark.createDataFrame([(s, a, b) for s, m in rules.items() for a, b in m.items()], "scope int, source string, target string")
    out = replace_scoped(df, flat, ["scope"], ["id"], "text", "out", "n", map_rules=map_rules)
    got = {r["id"]: r["out"] for r in out.collect()}
    assert got == {i: t if t is None else model.replace_all(t, rules.get(s, {})) for i, s, t in texts}


@pytest.mark.parametrize("map_rules", [0, 1 << 20])
def test_as_of(spark, map_rules, monkeypatch):
    monkeypatch.setattr("veilframe.operators.replace.MAP_RULES", map_rules)
    turns = [(s, i, word(5, 30, "abc ")) for s in range(4) for i in range(12)]
    known = {(s, w): i for s in range(4) for w, i in ((word(2, 3, "abc"), RANDOM.randint(0, 11)) for _ in range(4))}
    df = spark.createDataFrame(turns, "s int, i int, text string")
    vault = spark.createDataFrame([(s, w, f"<{w}>", i) for (s, w), i in known.items()], "s int, secret string, token string, first int")
    out = replace_scoped(
        df, vault.select("s", F.col("secret").alias("source"), F.col("token").alias("target"), "first"), ["s"], ["s", "i"],
        "text", "out", order="i", since="first", map_rules=map_rules)
    got = {(r["s"], r["i"]): r["out"] for r in out.collect()}
    want = {(s, i): model.replace_all(t, {w: f"<{w}>" for (a, w), f in known.items() if a == s and f <= i}) for s, i, t in turns}
    assert got == want
    same = mask_as_of(df, vault, ["s"], ["s", "i"], "i", "first", "text", "out")
    assert {(r["s"], r["i"]): r["out"] for r in same.collect()} == want


def test_global_dictionary_needs_length(spark):
    df = spark.createDataFrame([(1, "a secret-one a"), (2, "x")], "id int, text string")
    vault = spark.createDataFrame([("a", "<a>"), ("secret-one", "<s>")], "secret string, token string")
    got = mask_everywhere(df, vault, ["id"], "text", "out", min_secret_length=8).orderBy("id").collect()
    assert [r["out"] for r in got] == ["a <s> a", "x"]


@given(st.text(alphabet="abé😀", min_size=1, max_size=40), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_window_hash_depends_on_window_only(text, length):
    import numpy as np

    length = min(length, len(text))
    p = _Prefixes(text)
    for at in range(len(text) - length + 1):
        alone = _Prefixes(text[at:at + length]).windows(np.zeros(1, dtype=np.int64), length)[0]
        assert p.windows(np.array([at]), length)[0] == alone


def test_search_in_passes(spark, monkeypatch):
    """A filter far too small for the rules is used in passes over parts of them."""
    monkeypatch.setattr("veilframe.operators.replace.MAX_FILTER_BITS", 1 << 11)
    rules = {f"key{i:04d}": f"<{i}>" for i in range(600)}
    texts = [(i, "a", " ".join(RANDOM.choice([*rules, "key9999", "ke"]) for _ in range(15))) for i in range(40)]
    frame = spark.createDataFrame(texts, "id int, scope string, text string").repartition(3)
    flat = spark.createDataFrame([("a", s, t) for s, t in rules.items()], "scope string, source string, target string")
    out = replace_scoped(frame, flat, ["scope"], ["id"], "text", "out", "n", map_rules=0)
    assert {r["id"]: r["out"] for r in out.collect()} == {i: model.replace_all(t, rules) for i, _, t in texts}


def chop(text, cuts):
    marks = sorted({min(c, len(text)) for c in cuts})
    return [text[a:b] for a, b in zip([0, *marks], [*marks, len(text)])]


@given(st.dictionaries(st.text(alphabet="ab", min_size=1, max_size=5), st.text(alphabet="xy<>", max_size=3), max_size=6),
       st.text(alphabet="abc", max_size=40), st.lists(st.integers(0, 40), max_size=8))
@settings(max_examples=1500, deadline=None)
def test_chunking_never_changes_the_result(pairs, text, cuts):
    cutter = Dictionary(list(pairs.items()))
    out, tail = [], ""
    for chunk in chop(text, cuts):
        piece, tail = cutter.cut(tail, chunk)
        out.append(piece)
    assert "".join(out) + cutter.last(tail) == model.replace_all(text, pairs)


@given(st.lists(st.sampled_from(["__VAULT_JWT_12345678", "__", "_", "a", "__VAULT_", "9", "__VAULT_APIKEY_abcdef012__"]), max_size=12),
       st.lists(st.integers(0, 120), max_size=6))
@settings(max_examples=1500, deadline=None)
def test_no_token_is_torn(parts, cuts):
    text = "".join(parts)
    pairs = {"__VAULT_JWT_12345678__": "<j>", "__VAULT_APIKEY_abcdef012__": "<a>"}
    hold, out, tail = TokenHold(), [], ""
    for chunk in chop(text, cuts):
        piece, tail = hold.cut(tail, chunk)
        out.append(model.replace_all(piece, pairs))
    assert "".join(out) + model.replace_all(tail, pairs) == model.replace_all(text, pairs)


def test_restore(spark):
    a, b = "__VAULT_JWT_12345678__", "__VAULT_PRIVATE_KEY_abcdef012__"
    vault = spark.createDataFrame([(a, "one"), (b, "two $1 \\")], "token string, secret string")
    rows = [(1, f"{a}{b}", "onetwo $1 \\", 2), (2, "__VAULT_JWT_00000000__", "__VAULT_JWT_00000000__", 0), (3, f"{a[:-2]}{a}", None, 1),
            (4, "none", "none", 0), (5, f"__VAULT_JWT_00000000{a}", "__VAULT_JWT_00000000one", 1), (6, None, None, 0)]
    rows[2] = (3, f"{a}{a[2:]}", "one" + a[2:], 1)
    df = spark.createDataFrame([r[:2] for r in rows], "id int, text string")
    got = {r["id"]: (r["out"], r["n"]) for r in restore(df, vault, ["id"], "text", "out", "n").collect()}
    assert got == {r[0]: r[2:] for r in rows}


def test_restore_ansi(spark):
    red, off = "\x1b[31m", "\x1b[0m"
    vault = spark.createDataFrame([("__VAULT_JWT_12345678__", "one")], "token string, secret string")
    rows = [(1, f"a{red}__VA{off}ULT_JWT_1234{red}5678_{off}_{off}b", f"a{red}one{off}b"), (2, f"{red}x{off}", f"{red}x{off}"),
            (3, "__VAULT_JWT_12345678__ \x1b]0;__VAULT_JWT_12345678__", "one \x1b]0;__VAULT_JWT_12345678__")]
    df = spark.createDataFrame([r[:2] for r in rows], "id int, text string")
    got = {r["id"]: r["out"] for r in restore_ansi(df, vault, ["id"], "text", "out").collect()}
    assert got == {r[0]: r[2] for r in rows}


def events(spark, rows):
    return spark.createDataFrame(rows, "secret string, type string, source string, name string, n int").select(
        "secret", "type", "source", F.timestamp_seconds("n").alias("seen_at"), "name", F.struct("n").alias("ord"))


def test_vault_keeps_first_token_and_last_type(spark):
    vault = build_vault(events(spark, [("s", "JWT", "stdin", None, 2), ("s", "APIKEY", "proxy", "n", 1), ("s", "PASSWORD", None, None, 3)]), "x")
    row = vault.first()
    assert row["token"].startswith("__VAULT_APIKEY_") and row["type"] == "PASSWORD" and row["source"] == "stdin"
    assert row["name"] == "n" and row["created_at"].timestamp() == 1 and row["hit_count"] == 0


def test_forced_collisions(spark):
    """A generator with one hash for all: 60 secrets of one type run through short and long attempts."""
    def one(secret, type_, session):
        return F.concat(F.lit("__VAULT_"), type_, F.lit("_00000000__"))

    vault = build_vault(events(spark, [(f"s{i:02d}", "JWT", "stdin", None, i) for i in range(60)]), "x", one)
    tokens = {r["secret"]: r["token"] for r in vault.collect()}
    assert len(set(tokens.values())) == 60
    assert tokens["s00"] == "__VAULT_JWT_00000000__" and tokens["s01"] == "__VAULT_JWT_000000001__" and tokens["s15"] == "__VAULT_JWT_00000000f__"
    import hashlib

    assert tokens["s16"] == f"__VAULT_JWT_{hashlib.sha256(b's16x:16').hexdigest()[:9]}__"


def test_long_hash_conflicts_are_settled(spark):
    """A stored nine-digit token stands where a collision would go."""
    entries = spark.createDataFrame(
        [("a", "JWT", None, 1), ("b", "JWT", None, 2), ("c", "JWT", "__VAULT_JWT_000000001__", 0)],
        "secret string, first_type string, given_token string, n int").select(
        "secret", "first_type", "given_token", F.struct("n").alias("first_ord"))

    def one(secret, type_, session):
        return F.concat(F.lit("__VAULT_"), type_, F.lit("_00000000__"))

    tokens = {r["secret"]: r["token"] for r in assign_tokens(entries, "x", one).collect()}
    assert tokens["a"] == "__VAULT_JWT_00000000__" and tokens["c"] == "__VAULT_JWT_000000001__"
    assert len(set(tokens.values())) == 3


def test_names(spark):
    bad = spark.createDataFrame([("a", "n"), ("b", "n"), ("c", None), ("d", None)], "secret string, name string")
    assert [tuple(r) for r in name_conflicts(bad).collect()] == [("n", 2)]
    with pytest.raises(ValueError):
        require_unique_names(bad)


def test_rehydrate(spark):
    old = build_vault(events(spark, [("s", "JWT", "manual", "n", 1), ("t", "APIKEY", "stdin", None, 2)]), "old")
    old_tokens = {r["secret"]: r["token"] for r in old.collect()}
    none = spark.createDataFrame([], "record_id string")
    types = spark.createDataFrame([("APIKEY",)], "type string")
    got = {r["secret"]: r for r in rehydrate_vault(old, events(spark, [("s", "PASSWORD", "proxy", None, 5), ("u", "JWT", "stdin", None, 6)]),
                                                 "new", types, none).collect()}
    assert set(got) == {"s", "u"} and got["s"]["token"] == old_tokens["s"] and got["s"]["type"] == "PASSWORD" and got["s"]["name"] == "n"


def test_token_matches_hash(spark):
    import hashlib

    row = spark.range(1).select(vault_token(F.lit("é"), F.lit("JWT"), F.lit("s"))).first()[0]
    assert row == f"__VAULT_JWT_{hashlib.sha256('és'.encode()).hexdigest()[:8]}__"


def test_large_maps_grow_with_the_texts_not_with_texts_times_rules(spark):
    """4,000 texts of a scope with 2,500 rules took minutes when every row carried all rules; a null scope and nulls are kept."""
    words = [f"{i:04d}{chr(97 + i % 26)}" for i in range(2500)]
    rules = [("a", w, f"<{w[::-1]}>") for w in words] + [("a", words[7] + "xy", "<long>"), (None, "zz", "<null>")]
    texts = [(i, "a", " ".join(words[(i * 37 + j * j) % 2500] + "xy" * (j % 3 == 0) for j in range(120))) for i in range(4000)]
    texts += [(-1, None, "zzz"), (-2, "b", "zz" + words[0]), (-3, "a", None), (-4, "a", "")]
    df = spark.createDataFrame(texts, "id int, scope string, text string")
    table = spark.createDataFrame(rules, "scope string, source string, target string")
    began = time.monotonic()
    got = {r["id"]: r["out"] for r in replace_scoped(df, table, ["scope"], ["id"], "text", "out", map_rules=1 << 30).collect()}
    assert time.monotonic() - began < 60
    for i, scope, text in texts[::400] + texts[-4:]:
        pairs = {s: t for own, s, t in rules if own == scope}
        assert got[i] == (None if text is None else model.replace_all(text, pairs))
    assert len(got) == len(texts)


@pytest.mark.parametrize("parts", [1, 3])
def test_maps_too_large_for_a_worker_go_part_by_part(spark, monkeypatch, parts):
    """Rules over the limit are dealt to parts, and no row carries its scope's rules. Rows that share keys keep their own places."""
    from veilframe.operators import replace

    monkeypatch.setattr(replace, "MAP_RULES", 4)
    rules = {s: {word(1, 5): f"<{i}>" for i in range(40)} for s in (0, 1, None)}
    size = sum(64 + len(a) + len(b) for m in rules.values() for a, b in m.items())
    monkeypatch.setattr(replace, "BROADCAST_LIMIT_BYTES", -(-size // parts) - (parts == 1))
    monkeypatch.setattr(replace, "_replace_by_maps", None)
    monkeypatch.setattr("veilframe.streaming.cutters.Dictionary", None)
    texts = [(i // 2 if i % 3 else None, [0, 1, None, 7][i % 4], None if i == 8 else word(0, 60)) for i in range(200)] + [(5, 0, "")]
    texts += texts[:20]
    df = spark.createDataFrame(texts, "id int, scope int, text string").repartition(4)
    flat = spark.createDataFrame([(s, a, b) for s, m in rules.items() for a, b in m.items()], "scope int, source string, target string")
    out = replace.replace_scoped(df, flat, ["scope"], ["id"], "text", "out", map_rules=1 << 20)
    got = sorted(map(repr, map(tuple, out.collect())))
    assert got == sorted(repr((i, s, t, t if t is None else model.replace_all(t, rules.get(s, {})))) for i, s, t in texts)


def test_search_tries_no_rule_by_rule(spark, monkeypatch):
    """A text in which thousands of rules occur is passed over once; no expression tries each rule at each place."""
    from veilframe.operators import replace

    monkeypatch.setattr(replace, "replace_with_pairs", None)
    monkeypatch.setattr(replace, "count_matches", None)
    rules = {f"k{i:05d}": f"<{i}>" for i in range(3000)}
    texts = [(n, "a", " ".join(RANDOM.choice(["k77777 and the", *rules]) for _ in range(4000))) for n in range(3)]
    df = spark.createDataFrame(texts, "id int, scope string, text string")
    flat = spark.createDataFrame([("a", s, t) for s, t in rules.items()], "scope string, source string, target string")
    monkeypatch.setattr(replace, "_replace_by_maps", lambda df, *a: df.withColumn("out", F.col("text")).withColumn("n", F.lit(0)))
    out = replace.replace_scoped(df, flat, ["scope"], ["id"], "text", "out", "n", map_rules=0).collect()
    assert all(r["out"] == " ".join(rules.get(w, w) for w in r["text"].split(" ")) for r in out) and len(out) == 3
    assert all(r["n"] == sum(w in rules for w in r["text"].split(" ")) for r in out)


def test_search_keeps_rows_that_share_keys_apart(spark):
    texts = [(1, "a", "one two"), (1, "b", "one two"), (1, "a", "one"), (1, "a", "one"), (None, "b", "two"), (None, None, "two two")]
    rules = [("a", "one", "<a>"), ("b", "one", "<b>"), ("b", "two", "<2>"), (None, "two", "<n>")]
    df = spark.createDataFrame(texts, "id int, scope string, text string")
    flat = spark.createDataFrame(rules, "scope string, source string, target string")
    out = replace_scoped(df, flat, ["scope"], ["id"], "text", "out", "n", map_rules=0)
    got = sorted(map(repr, ((r["id"], r["scope"], r["out"], r["n"]) for r in out.collect())))
    assert got == sorted(map(repr, [(1, "a", "<a> two", 1), (1, "b", "<b> <2>", 2), (1, "a", "<a>", 1), (1, "a", "<a>", 1),
                                    (None, "b", "<2>", 1), (None, None, "<n> <n>", 2)]))
