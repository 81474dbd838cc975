"""Null keys, torn tokens, repeated rules, closed streams, and what a job leaves behind."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from veilframe.config import DetectOptions
from veilframe.functions.http import first_header, is_text_content
from veilframe.functions.text import is_token, normalize_name, register_sql_functions
from veilframe.operators.chunks import reassemble, token_safe
from veilframe.operators.replace import replace_scoped
from veilframe.operators.restore import restore
from veilframe.operators.vault import build_vault, rehydrate_vault, select_persistable, sightings
from veilframe.plans.pipelines import mask_corpus, mask_traffic, register_by_hand
from veilframe.session import ensure_checkpoint_dir, scratch_tables
from veilframe.streaming import jobs
from test_streaming import drain, feed


def at():
    return F.timestamp_seconds(F.lit(1))



def test_rows_with_null_keys_are_masked(spark):
    df = spark.createDataFrame([(1, "password = hunter2hunter2"), (None, "password = hunter3hunter3"), (None, "plain")], "id int, text string")
    got = {(r["text"], r["n_masked"]): r["masked_text"] for r in mask_corpus(df, ["id"], "text", "s", at()).texts.collect()}
    assert all("hunter" not in v for v in got.values()) and got[("plain", 0)] == "plain"
    rules = spark.createDataFrame([(None, f"w{i}", f"<{i}>") for i in range(6)], "k string, source string, target string")
    texts = spark.createDataFrame([(None, 1, "w1 w3"), ("a", 2, "w1")], "k string, id int, text string")
    for most in (256, 2):
        rows = {r["id"]: r["out"] for r in replace_scoped(texts, rules, ["k"], ["id"], "text", "out", map_rules=most).collect()}
        assert rows == {1: "<1> <3>", 2: "w1"}


def test_rules_that_share_a_source(spark):
    rules = spark.createDataFrame([(0, "abc", "<2>"), (0, "abc", "<1>")], "k int, source string, target string")
    texts = spark.createDataFrame([(0, 1, "x abc")], "k int, id int, text string")
    assert replace_scoped(texts, rules, ["k"], ["id"], "text", "out").first()["out"] == "x <1>"
    vault = spark.createDataFrame([("__VAULT_JWT_12345678__", "b"), ("__VAULT_JWT_12345678__", "a")], "token string, secret string")
    df = spark.createDataFrame([(1, "__VAULT_JWT_12345678__!")], "id int, text string")
    assert restore(df, vault, ["id"], "text", "out").first()["out"] == "a!"


@pytest.mark.parametrize("rows,size", [(1, 7), (2, 7), (1, 1), (16, 3), (1, 40)])
def test_tokens_over_many_segments(spark, rows, size):
    rng = random.Random(rows * size)
    tokens = [f"__VAULT_{k}_{i:08x}__" for i, k in enumerate(["PRIVATE_KEY", "JWT", "GENERIC"])]
    vault = spark.createDataFrame([(t, f"<{i}>") for i, t in enumerate(tokens)], "token string, secret string")
    texts = ["".join(rng.choice([*tokens, " word ", "_", "__", "é"]) for _ in range(60)) for _ in range(3)]
    texts += ["x" * 5000 + tokens[0] + "y" * 5000 + tokens[1], tokens[0] * 200, (tokens[0][:-2]) * 150 + "__ end", ""]
    chunks = [(k, i, t[i * size:(i + 1) * size]) for k, t in enumerate(texts) for i in range(-(-len(t) // size))] + [(7, i, None) for i in range(9)]
    df = spark.createDataFrame(chunks, "k int, seq long, chunk string").repartition(3)
    segments = token_safe(reassemble(df, ["k"], "seq", "chunk", rows=rows), ["k"])
    parts = restore(segments, vault, ["k", "segment"], "text", "out")
    got = {r["k"]: r["t"] for r in parts.groupBy("k").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("segment", "out"))), lambda p: p["out"]), "").alias("t")).collect()}
    whole = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    want = {r["k"]: r["out"] for r in restore(whole, vault, ["k"], "text", "out").collect()}
    assert {k: got.get(k, "") for k in want} == want and got[7] == ""


def test_tokens_outside_the_grammar_are_refused(spark):
    found = spark.createDataFrame([("s1", "JWT", 1)], "value string, type string, pos int")
    events = sightings(found, "proxy", at(), ["pos"])
    with pytest.raises(Exception, match="not a vault token"):
        build_vault(events, "s", generator=lambda secret, kind, session: F.concat(F.lit("__VAULT_"), kind, F.lit("_1__"))).collect()


def test_names_are_unique(spark):
    entries = spark.createDataFrame([("db", "one secret", 1), (" db ", "other secret", 2)], "name string, secret string, pos int")
    with pytest.raises(ValueError):
        register_by_hand(entries, "s", at(), ["pos"])
    one = register_by_hand(entries.limit(1), "s", at(), ["pos"])
    assert select_persistable(one).count() == 1 and select_persistable(one.withColumn("source", F.lit("proxy"))).count() == 0
    nothing = sightings(spark.createDataFrame([], "value string, type string, pos int"), "proxy", at(), ["pos"])
    ids = one.select(F.substring(F.sha2("secret", 256), 1, 12).alias("record_id"))
    types = spark.createDataFrame([], "type string")
    assert rehydrate_vault(one, nothing, "s", types, ids).count() == 0
    assert rehydrate_vault(one, nothing, "s", types, ids.limit(0)).count() == 1


def test_text_ends(spark):
    register_sql_functions(spark)
    df = spark.createDataFrame([("__VAULT_JWT_12345678__\n",), ("__VAULT_JWT_12345678__",), ("\tabc\n",), (" \u3000",)], "s string")
    rows = df.select(is_token(F.col("s")).alias("a"), F.expr("is_vault_token(s)").alias("b"), normalize_name(F.col("s")).alias("c"),
                     F.expr("normalize_name(s)").alias("d")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] == [False, True, False, False]
    assert [r["c"] for r in rows] == [r["d"] for r in rows] and rows[2]["c"] == "abc" and rows[3]["c"] is None


def test_header_names_in_any_case(spark):
    df = spark.createDataFrame([({"Content-Type": ["image/png"]},), ({},)], "h map<string,array<string>>")
    assert [tuple(r) for r in df.select(first_header(F.col("h"), "content-type"), is_text_content(F.col("h"))).collect()] == [("image/png", False), (None, True)]


def test_traffic_of_a_session(spark):
    log = [("a", 0, "use hunter2hunter2 first"), ("a", 1, "password = hunter2hunter2"), ("a", 2, "use hunter2hunter2 again"),
           ("b", 0, "hunter2hunter2 elsewhere, known-from-before"), (None, 1, "token: zxcvbnm1 "), (None, 2, "zxcvbnm1 known-from-before")]
    df = spark.createDataFrame([(*r, "/v1/messages", {"content-type": ["application/json"]}) for r in log],
                               "conv string, turn int, body string, path string, headers map<string,array<string>>")
    stored = spark.createDataFrame([("__VAULT_GENERIC_0000000a__", "known-from-before", "GENERIC", None, 0, None, "manual")],
                                   "token string, secret string, type string, created_at timestamp, hit_count long, name string, source string")
    run = mask_traffic(df, ["conv", "turn"], "s", F.timestamp_seconds(F.col("turn")), DetectOptions(entropy=False), scope=["conv"], order="turn", known_vault=stored)
    got = {(r["conv"], r["turn"]): r["masked_body"] for r in run.texts.collect()}
    assert got[("a", 0)] == log[0][2] and "hunter2" not in got[("a", 1)] + got[("a", 2)]
    assert got[("b", 0)] == "hunter2hunter2 elsewhere, __VAULT_GENERIC_0000000a__"
    assert "zxcvbnm1" not in got[(None, 1)] + got[(None, 2)] and got[(None, 2)].endswith("__VAULT_GENERIC_0000000a__")


def test_nothing_in_clear_is_left_behind(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    df = spark.createDataFrame([(1, "password = plantedsecret77")], "id int, text string")
    with scratch_tables(spark):
        mask_corpus(df, ["id"], "text", "s", at()).texts.select("id", "masked_text").write.parquet(str(tmp_path / "out"))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    files = [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names]
    assert not any(b"plantedsecret77" in open(f, "rb").read() for f in files)
    assert "plantedsecret77" not in spark.read.parquet(str(tmp_path / "out")).first()["masked_text"]


def test_closed_streams_stay_closed(spark, tmp_path):
    schema = "s string, seq long, chunk string, is_last boolean"
    stream = feed(spark, tmp_path, [[("s", 0, "ab", False), ("s", 1, "c", True)], [("s", 1, "c", True), ("s", 0, "ab", False), ("s", 3, "z", False)]], schema)
    rows = drain(jobs.replace_stream(stream, ["s"], [("abc", "<1>")]), tmp_path).orderBy("seq").collect()
    assert "".join(r["piece"] for r in rows) == "<1>"


def test_window_sorts_a_whole_micro_batch(spark, tmp_path):
    turns = [("s", i, chr(97 + i)) for i in range(9)]
    random.Random(2).shuffle(turns)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        stream = feed(spark, tmp_path, [turns], "s string, seq long, chunk string")
        rows = drain(jobs.window_stream(stream, ["s"], "seq", "chunk", window=4), tmp_path).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r["window_text"] for r in rows] == ["abcdefghi"[max(0, i - 3):i + 1] for i in range(9)]
