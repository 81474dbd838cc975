"""Blocked ordered state, chunk assembly, frames, threads against sequential Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import model
from veilframe.operators.chunks import frames_to_messages, inspected_arguments, mark_text_frames, reassemble, system_runs, token_safe
from veilframe.operators.ordered import lagged, numbered, rolling_text, running
from veilframe.operators.responses import response_events
from veilframe.operators.threads import thread_history, thread_index

RANDOM = random.Random(3)


@pytest.fixture(scope="module")
def history():
    rows = []
    for key in ("a", "b", None):
        orders = sorted(RANDOM.sample(range(200), 60))
        rows += [(key, o, RANDOM.choice([None, 1, 2]), "".join(RANDOM.choices("xyz", k=RANDOM.choice([0, 0, 3, 9])))) for o in orders]
    return rows


def by_key(rows):
    keys = {}
    for r in rows:
        keys.setdefault(r[0], []).append(r)
    return keys.values()


def test_running(spark, history):
    df = spark.createDataFrame(history, "k string, o long, v int, t string").repartition(5)
    got = {(r["k"], r["o"]): (r["i"], r["s"], r["p"]) for r in running(
        numbered(df, ["k"], "o", "i", span=7), ["k"], "o", {"s": F.coalesce("v", F.lit(0))}, {"p": F.col("v")}, span=7).collect()}
    want = {}
    for rows in by_key(history):
        total, last = 0, None
        for i, (k, o, v, _) in enumerate(rows):
            want[(k, o)] = (i, total, last)
            total, last = total + (v or 0), v if v is not None else last
    assert got == want


def test_lagged_keeps_nulls(spark, history):
    df = spark.createDataFrame(history, "k string, o long, v int, t string")
    got = {(r["k"], r["o"]): r["p"] for r in lagged(df, ["k"], "o", F.col("v"), "p", span=7).collect()}
    want = {(r[0], r[1]): (rows[i - 1][2] if i else None) for rows in by_key(history) for i, r in enumerate(rows)}
    assert got == want


@pytest.mark.parametrize("window,bucket", [(5, 5), (5, 12), (40, 64), (1, 1)])
def test_rolling_text(spark, history, window, bucket):
    df = spark.createDataFrame(history, "k string, o long, v int, t string")
    got = {(r["k"], r["o"]): r["w"] for r in rolling_text(df, ["k"], "o", F.col("t"), "w", window, bucket, span=7).collect()}
    want = {}
    for rows in by_key(history):
        text = ""
        for k, o, _, t in rows:
            text += t
            want[(k, o)] = text[-window:]
    assert got == want


def test_reassemble_in_segments(spark, history):
    df = spark.createDataFrame(history, "k string, o long, v int, t string").repartition(3)
    got = {(r["k"], r["segment"]): r["text"] for r in reassemble(df, ["k"], "o", "t", rows=16).collect()}
    want = {(rows[0][0], s): "".join(r[3] for r in rows[s * 16:s * 16 + 16]) for rows in by_key(history) for s in range(4)}
    assert got == want


def test_segments_never_tear_tokens(spark):
    pairs = {"__VAULT_JWT_12345678__": "<j>"}
    parts = ["__VAULT_JWT_12345678__", "__VAULT_JWT_12345678", "__", "_", "a b", "__VAULT_", "text"]
    texts = {i: "".join(RANDOM.choices(parts, k=8)) for i in range(60)}
    chunks = [(i, s // 3, t[s:s + 3]) for i, t in texts.items() for s in range(0, len(t), 3)]
    df = spark.createDataFrame(chunks, "k int, o long, t string")
    segments = token_safe(reassemble(df, ["k"], "o", "t", rows=25), ["k"]).collect()
    got = {}
    for r in sorted(segments, key=lambda r: (r["k"], r["segment"])):
        got[r["k"]] = got.get(r["k"], "") + model.replace_all(r["text"], pairs)
    assert got == {i: model.replace_all(t, pairs) for i, t in texts.items()}


def test_frames(spark):
    rows = [(c, i, RANDOM.choice([0, 0, 0, 1, 2, 9]), RANDOM.random() < 0.4, f"{i};") for c in range(4) for i in range(80)]
    df = spark.createDataFrame(rows, "c int, seq long, opcode int, fin boolean, payload string")
    texts, marks = {}, {}
    for c in range(4):
        inside, current, done = False, [], []
        for _, i, op, fin, p in (r for r in rows if r[0] == c):
            text = op == 1 or (op == 0 and inside)
            marks[(c, i)] = text
            if text:
                current.append(p)
                inside = not fin
                if fin:
                    done.append("".join(current))
                    current = []
        texts[c] = done + (["".join(current)] if current else [])
    assert {(r["c"], r["seq"]): r["is_text"] for r in mark_text_frames(df, ["c"], "seq").collect()} == marks
    got = {}
    for r in frames_to_messages(df, ["c"], "seq").orderBy("c", "message").collect():
        got.setdefault(r["c"], []).append(r["text"])
    assert got == texts


def test_arguments(spark):
    args = ["tool", "-c", "token=a", "x", "--eval", "-e", "y", "-lc", "--command"]
    df = spark.createDataFrame([(1, i, a) for i, a in enumerate(args)], "c int, pos long, arg string")
    got = [r["inspected"] for r in inspected_arguments(df, ["c"], "pos", "arg").orderBy("pos").collect()]
    assert got == [True, True, False, True, True, False, False, True, False]


def test_system_runs(spark):
    rows = [(1, i, r, t, b) for i, (r, t, b) in enumerate([
        ("system", "a", False), ("system", "b", False), ("user", "u", False), ("system", "c", True), ("system", "d", False),
        ("system", "", False), ("system", "e", False)])]
    df = spark.createDataFrame(rows, "th int, o long, role string, text string, blocked boolean")
    got = [(r["role"], r["text"], r["n_merged"]) for r in system_runs(
        df, ["th"], "o", "role", "text", F.col("blocked")).orderBy("first_order").collect()]
    assert got == [("system", "a\n\nb", 2), ("user", "u", 1), ("system", "c", 1), ("system", "d\n\ne", 3)]


def test_threads_with_branches(spark):
    parents = {0: None, 100: 77}
    for i in range(1, 60):
        parents[i] = RANDOM.choice([i - 1, RANDOM.randrange(i)])
    df = spark.createDataFrame([(str(i), None if p is None else str(p), f"m{i}") for i, p in parents.items()], "id string, prev string, m string")

    def path(i):
        return (path(parents[i]) if parents[i] in parents else []) + [i]

    index = {r["id"]: (r["root"], r["depth"]) for r in thread_index(df, "id", "prev").collect()}
    assert index == {str(i): (str(path(i)[0]), len(path(i)) - 1) for i in parents}
    got = {}
    for r in thread_history(df, "id", "prev", ["m"]).orderBy("response_id", "position").collect():
        got.setdefault(r["response_id"], []).append(r["m"])
    leaves = [i for i in parents if i not in parents.values()]
    assert got == {str(i): [f"m{j}" for j in path(i)] for i in leaves}
    every = thread_history(df, "id", "prev", ["m"], leaves_only=False).count()
    assert every == sum(len(path(i)) for i in parents)


def test_cycle_is_refused(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, prev string")
    with pytest.raises(ValueError):
        thread_index(df, "id", "prev")


def test_response_events(spark):
    lines = [
        'data: {"choices":[{"delta":{"content":"Hi"}}]}', ": comment", 'data: {"choices":[{"delta":{"tool_calls":[{"index":5,"id":"c5","function":{"name":"f","arguments":"{"}}]}}]}',
        'data: {"choices":[{"delta":{"content":" you","tool_calls":[{"index":5,"function":{"name":"","arguments":"}"}},{"index":2,"function":{"arguments":"x"}}]}}]}',
        'data: not json', 'data: {"choices":[{"delta":{},"finish_reason":"stop"}]}', "data: [DONE]"]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(lines)], "s string, seq long, line string")
    rows = response_events(df, ["s"], "seq", "line").orderBy("phase", "seq", "sub", "part").collect()
    short = [(r["type"].replace("response.", ""), r["output_index"], r["text"], r["name"]) for r in rows]
    assert short == [
        ("created", 0, None, None),
        ("output_item.added", 0, None, None), ("content_part.added", 0, "", None), ("output_text.delta", 0, "Hi", None),
        ("output_item.added", 1, None, "f"), ("function_call_arguments.delta", 1, "{", None),
        ("output_text.delta", 0, " you", None), ("function_call_arguments.delta", 1, "}", None),
        ("output_item.added", 2, None, "tool"), ("function_call_arguments.delta", 2, "x", None),
        ("output_text.done", 0, "Hi you", None), ("content_part.done", 0, "Hi you", None), ("output_item.done", 0, "Hi you", None),
        ("function_call_arguments.done", 1, "{}", "f"), ("output_item.done", 1, "{}", "f"),
        ("function_call_arguments.done", 2, "x", "tool"), ("output_item.done", 2, "x", "tool"),
        ("completed", 0, None, None)]
    assert {r["call_id"] for r in rows if r["output_index"] == 1 and r["call_id"]} == {"c5"}
    assert re.fullmatch("msg_[0-9a-f]{12}", rows[1]["item_id"])


def test_requests_with_their_history(spark):
    """Ids stored again, unknown ids, branches and missing responses against a store that is written row by row."""
    import json

    from veilframe.operators.threads import chat_requests_with_history, stored_history

    log, store, want = [], {}, {}
    for at in range(60):
        ident, before = f"r{RANDOM.randrange(25)}", RANDOM.choice([None, "gone", *store])
        fresh = RANDOM.choice(["hi", "", [{"role": "developer", "content": "rule"}, {"role": "user", "content": f"q{at}"}]])
        body = {"input": fresh, **({"instructions": "brief"} if RANDOM.random() < 0.7 else {})}
        answer = json.dumps({"choices": [{"message": {"content": f"a{at}"}}]}) if RANDOM.random() < 0.9 else None
        log.append((ident, before, at, json.dumps(body), answer))
        messages = list(store.get(before, []))
        entries = [("system", "brief")] if not messages and "instructions" in body else []
        entries += [("user", fresh)] if isinstance(fresh, str) and fresh else [("system" if e["role"] == "developer" else e["role"], e["content"]) for e in fresh or []]
        for role, text in entries:
            if role == "system" and messages and messages[-1][0] == "system":
                messages[-1] = ("system", messages[-1][1] + "\n\n" + text)
            else:
                messages.append((role, text))
        want[at] = list(messages)
        store[ident] = messages + ([("assistant", f"a{at}")] if answer else [])
    frame = spark.createDataFrame(log, "id string, before string, at long, request string, response string").repartition(3)
    names = ("id", "before", "at", "request", "response")
    got = {r["at"]: r for r in chat_requests_with_history(frame, *names, leaves_only=False).collect()}
    assert {at: [(m["role"], m["text"] or "") for m in r["chat"]["messages"]] for at, r in got.items()} == want
    leaves = {r["at"] for r in chat_requests_with_history(frame, *names).collect()}
    assert leaves < set(want) and all(at in leaves for at in range(60) if not any(b == log[at][0] and t > at for _, b, t, *_ in log))
    cut = chat_requests_with_history(frame, *names, leaves_only=False, rows=2).collect()
    deep = {r["at"] for r in cut if r["n_segments"] > 1}
    assert deep and all((r["chat"] is None) == (r["at"] in deep) for r in cut)
    parts = {}
    for r in sorted(stored_history(frame, *names, leaves_only=False, rows=2).collect(), key=lambda r: (r["node"], r["segment"])):
        parts.setdefault(int(r["node"].split(":")[1]), []).extend((m["role"], m["text"]) for m in r["messages"])
    assert all(want[at][:len(parts[at])] == parts[at] for at in deep if all(r[4] for r in log))
