"""Streams in several micro-batches, out of order, and with late ends."""

from __future__ import annotations

import random

import model
import pytest
from veilframe.functions.text import strip_tokens
from veilframe.session import shared_folder
from veilframe.streaming import jobs
from veilframe.streaming.cutters import Dictionary
from veilframe.streaming.state import DealtStreams, Fields, RuleFollowing
from pyspark.sql import Row
from pyspark.sql import functions as F

RANDOM = random.Random(5)
SCHEMA = "s string, seq long, chunk string, is_last boolean"


def feed(spark, tmp_path, batches, schema):
    """Every batch becomes one file, read in order, one per trigger."""
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"b{i:03d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))


def drain(stream, tmp_path):
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(
        availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def test_out_of_order_over_batches(spark, tmp_path):
    pairs = {"abc": "<1>", "bca": "<2>", "a": "<3>"}
    texts = {f"s{i}": "".join(RANDOM.choices("abcd", k=40)) for i in range(6)}
    chunks = [(s, i // 3, t[i:i + 3], i + 3 >= len(t)) for s, t in texts.items() for i in range(0, len(t), 3)]
    RANDOM.shuffle(chunks)
    stream = feed(spark, tmp_path, [chunks[:30], chunks[30:60] + chunks[:5], chunks[60:]], SCHEMA)
    rows = drain(jobs.replace_stream(stream, ["s"], list(pairs.items())), tmp_path).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["s"], r["synthetic"], r["seq"])):
        got[r["s"]] = got.get(r["s"], "") + r["piece"]
    assert got == {s: model.replace_all(t, pairs) for s, t in texts.items()}


def test_rolling_window_sees_torn_tokens(spark, tmp_path):
    stream = feed(spark, tmp_path, [[("s", 0, "a __VAULT_JWT")], [("s", 1, "_12345678__ b")], [("s", 2, "c")]], "s string, seq long, chunk string")
    rows = drain(jobs.window_stream(stream, ["s"], "seq", "chunk", window=6), tmp_path).orderBy("seq").collect()
    # An unfinished head is cut off with all behind it, so what follows stands alone.
    assert [r["window_text"] for r in rows] == ["a ", "78__ b", "8__ bc"]


def test_window_equals_batch_for_whole_tokens(spark, tmp_path):
    texts = [("s", i, RANDOM.choice(["ab __VAULT_JWT_12345678__ c", "x", "", "long text of a turn"])) for i in range(9)]
    stream = feed(spark, tmp_path, [texts[:4], texts[4:]], "s string, seq long, chunk string")
    rows = drain(jobs.window_stream(stream, ["s"], "seq", "chunk", window=20), tmp_path).collect()
    from veilframe.operators.sessions import window_text

    batch = window_text(spark.createDataFrame(texts, "s string, seq long, chunk string"), ["s"], "seq", "chunk", window=20)
    assert {(r["seq"], r["window_text"]) for r in rows} == {(r["seq"], r["window_text"]) for r in batch.collect()}
    assert spark.range(1).select(strip_tokens(F.lit("a__VAULT_x"))).first()[0] == "a"


def test_sessions_over_batches(spark, tmp_path):
    secret = "hunter2hunter2"
    turns = [[("s", 0, f"hello {secret}\n"), ("t", 0, "x")], [("s", 1, f"password = {secret}; ok\n")], [("s", 2, f"and {secret}!"), ("t", 1, secret)]]
    stream = feed(spark, tmp_path, turns, "s string, seq long, text string")
    windows = jobs.window_stream(stream, ["s"], "seq", "text")
    sink = jobs.mask_sessions_to(spark, ["s"], "seq", "text", "id", str(tmp_path / "vault"), str(tmp_path / "masked"))
    jobs.start_batches(windows, sink, str(tmp_path / "ck")).awaitTermination()
    got = {(r["s"], r["seq"]): r["masked_text"] for r in spark.read.parquet(str(tmp_path / "masked")).collect()}
    token = spark.read.parquet(str(tmp_path / "vault")).first()["token"]
    assert got == {("s", 0): f"hello {secret}\n", ("s", 1): f"password = {token}; ok\n", ("s", 2): f"and {token}!", ("t", 0): "x", ("t", 1): secret}


def test_dictionary_is_refused_not_cut(spark):
    import pytest

    rules = spark.range(20).select(F.col("id").cast("string").alias("source"), F.lit("x").alias("target"))
    with pytest.raises(ValueError):
        jobs.dictionary(rules, limit=100)
    assert len(jobs.dictionary(rules).pairs) == 20
    sent = jobs.dictionary(rules.unionByName(rules.where("id = 3").withColumn("target", F.lit("a"))), inline=0)
    assert sent.pairs is None and sent.last("1 3 20") == "x a xx"


class Store(dict):
    """State variables of one grouping key, with a count of the calls."""

    calls = 0

    def getListState(self, name, schema):
        store, at = self, name

        class Listed:
            def get(self):
                Store.calls += 1
                return iter(list(store.get(at, [])))

            def put(self, rows):
                assert rows
                Store.calls += 1
                store[at] = list(rows)

            def appendList(self, rows):
                Store.calls += 1
                store[at] = store.get(at, []) + list(rows)

            def appendValue(self, row):
                self.appendList([row])

            def clear(self):
                Store.calls += 1
                store.pop(at, None)

        return Listed()

    def getMapState(self, name, keys, values):
        store, at = self, name

        class Mapped:
            def getValue(self, key):
                Store.calls += 1
                return store[at, key]

            def updateValue(self, key, value):
                Store.calls += 1
                store[at, key] = value

            def removeKey(self, key):
                Store.calls += 1
                del store[at, key]

        return Mapped()


def dealt(processor, store, batches):
    """What a processor of packs gives for one group over micro-batches."""
    made = []
    for batch in batches:
        processor.init(store)
        packs = [Row("_group", *"abcdefghij"[:len(batch[0])])(0, *map(list, zip(*batch[i:i + 40]))) for i in range(0, len(batch), 40)]
        for out in processor.handleInputRows((0,), iter(packs), None):
            made += zip(*out)
    return made


@pytest.mark.parametrize("held, inline, most", [(1 << 16, 256, 15), (50, 3, None)])
def test_streams_of_a_group_share_their_calls(monkeypatch, held, inline, most):
    """300 streams over three micro-batches: a few calls for the group, or blocks when more rows wait than memory may hold."""
    monkeypatch.setattr("veilframe.streaming.state.HELD", held)
    monkeypatch.setattr("veilframe.streaming.state.INLINE", inline)
    rng, rows, texts = random.Random(5), [], {}
    for stream in [None, *range(299)]:
        texts[stream] = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 90)))
        pieces = [texts[stream][i:i + 7] for i in range(0, len(texts[stream]), 7)]
        rows += [(stream, i, i == len(pieces) - 1, [""], [p]) for i, p in enumerate(pieces)]
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[0] == 7)  # a stream that comes last as a whole
    third, store = len(rows) // 3, Store()
    Store.calls = 0
    batches = [rows[:third], rows[third:2 * third], rows[2 * third:], rows[:50]]  # the last are delivered again
    made = dealt(DealtStreams(["s", "seq", "field_key", "piece", "synthetic"], ["s"], Fields({None: Dictionary([("ab", "X"), ("ba ", "Y")])})), store, batches)
    found = {}
    for stream, seq, _, piece, synthetic in sorted(made, key=lambda r: (r[1], r[4])):
        found[stream] = found.get(stream, "") + piece
    assert found == {s: Dictionary([("ab", "X"), ("ba ", "Y")]).last(t) for s, t in texts.items()}
    assert not store.get("open") and not any(isinstance(k, tuple) for k in store)
    assert most is None or Store.calls <= most


@pytest.mark.parametrize("held", [1 << 16, 20])
def test_scopes_of_a_group_follow_their_own_rules(monkeypatch, held):
    monkeypatch.setattr("veilframe.streaming.state.HELD", held)
    monkeypatch.setattr("veilframe.streaming.state.INLINE", 2)
    batches = [[], [], []]
    for scope in range(40):
        rule = (scope, None, None, None, False, None, f"pw{scope:02d}", f"<{scope:02d}>", 1)
        batches[1].append(rule)
        batches[2].append((*rule[:7], f"[{scope:02d}]", 2))
        for n, batch in enumerate(batches):
            text, way = (f"say pw{scope:02d}.", "in") if n < 2 else (f"got [{scope:02d}] pw{scope:02d}", "out")
            pieces = [text[i:i + 3] for i in range(0, len(text), 3)]
            batch += [(scope, str(n), way, i, i == len(pieces) - 1, p, None, None, None) for i, p in reversed(list(enumerate(pieces)))]
    made = dealt(RuleFollowing(["scope", "stream", "direction", "seq", "piece", "synthetic"], ["scope"]), Store(), [b[::-1] for b in batches])
    found = {}
    for scope, stream, _, seq, piece, _ in sorted(made, key=lambda r: (r[3], r[5])):
        found[scope, stream] = found.get((scope, stream), "") + piece
    for scope in range(40):
        secret = f"pw{scope:02d}"
        assert [found[scope, str(n)] for n in range(3)] == [f"say {secret}.", f"say <{scope:02d}>.", f"got {secret} {secret}"]


def test_places_of_a_replay_are_micro_batches(spark):
    """Places with rows in few partitions have as many files as the others."""
    from veilframe.plans.stream_queries import replayed

    rows = spark.range(100, numPartitions=5).select("id", F.when(F.col("id") < 60, 0).when(F.col("id") < 80, 1).otherwise(2).alias("place"))
    seen = []
    replayed(spark, rows, F.col("place")).writeStream.foreachBatch(
        lambda batch, i: seen.append({r["place"] for r in batch.collect()})).option("checkpointLocation", shared_folder(spark, "ckpt")).trigger(
        availableNow=True).start().awaitTermination()
    assert seen == [{0}, {1}, {2}]


def test_pieces_that_cannot_tear_a_token_are_not_searched(monkeypatch):
    """What most pieces are: neither an underscore near the end nor an escape. The others are searched as ever."""
    from veilframe.streaming import cutters

    class Fails:
        def search(self, *where):
            raise AssertionError("searched")

    with monkeypatch.context() as patched:
        for name in ("_OPEN", "_BROKEN"):
            patched.setattr(cutters, name, Fails())
        for text in ("", "plain words", "a_b " + "x" * 64):
            assert cutters.TokenHold().cut("", text) == (text, "") and cutters.AnsiTokenHold().cut("", text) == (text, "", False)
    assert cutters.AnsiTokenHold().cut("", "key __VAULT_API") == ("key ", "__VAULT_API", False)
    assert cutters.AnsiTokenHold().cut("", "key _\x1b[1m_V") == ("key ", "_\x1b[1m_V", False)
