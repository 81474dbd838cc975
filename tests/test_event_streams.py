"""Streams that keep their form: event lines, response events, rules that change, terminal output, late turns."""

from __future__ import annotations

import json
import random

import model
import pytest
from test_streaming import drain, feed

from veilframe.functions.text import strip_ansi
from veilframe.operators.responses import response_events
from veilframe.operators.restore import restore_ansi
from veilframe.streaming import jobs
from veilframe.streaming.cutters import AnsiTokenHold, Dictionary, TokenHold
from veilframe.streaming.events import body_cells

RANDOM = random.Random(11)
TOKENS = {"__VAULT_JWT_12345678__": 'se"cr\\et\n1', "__VAULT_APIKEY_0123abcde__": "secrét2"}
PARTS = [*TOKENS, "__VAULT_JWT_12345678", "__", "_", "a b", "__VAULT_", "VAULT_APIKEY_0123abcde__", "__VAULT_JWT_99999999__", 'q"\\', "é\n"]


def cut_by(cutter, text, size, finish=lambda piece: piece):
    held, out = "", []
    for at in range(0, len(text), size):
        piece, held = cutter.cut(held, text[at:at + size])[:2]
        out.append(finish(piece))
    return "".join(out) + finish(cutter.last(held))


def test_dictionary_over_any_chunks():
    for _ in range(1500):
        rules = {"".join(RANDOM.choices("abc", k=RANDOM.randint(1, 6))): f"<{i}>" for i in range(RANDOM.randint(0, 6))}
        text = "".join(RANDOM.choices("abcd", k=RANDOM.randint(0, 50)))
        assert cut_by(Dictionary(list(rules.items())), text, RANDOM.randint(1, 9)) == model.replace_all(text, rules)


def test_tokens_over_any_chunks_and_runs_of_any_length():
    def restored(text):
        return model.replace_all(text, TOKENS)

    for _ in range(800):
        text = "".join(RANDOM.choices(PARTS, k=RANDOM.randint(1, 12)))
        assert cut_by(TokenHold(), text, RANDOM.randint(1, 12), restored) == restored(text)
    for run in ("__VAULT_JWT_12345678" * 300, "__VAULT_JWT_87654321" * 300 + "__VAULT_JWT_12345678"):
        assert len(run) > 5000 and cut_by(TokenHold(), run + "__ x", 11, restored) == restored(run + "__ x")


def test_a_large_dictionary(spark, tmp_path):
    rules = [(f"key-{i:06d}-{i * 7919 % 100000:05d}", f"<{i}>") for i in range(100_000)]
    texts = {f"s{j}": " ".join(rules[RANDOM.randrange(100_000)][0] + RANDOM.choice(["", "x", " key-0"]) for _ in range(20)) for j in range(5)}
    chunks = [(s, i // 7, t[i:i + 7], i + 7 >= len(t)) for s, t in texts.items() for i in range(0, len(t), 7)]
    RANDOM.shuffle(chunks)
    stream = feed(spark, tmp_path, [chunks[::2], chunks[1::2]], "s string, seq long, chunk string, is_last boolean")
    got = {}
    for r in sorted(drain(jobs.replace_stream(stream, ["s"], rules), tmp_path).collect(), key=lambda r: (r["s"], r["synthetic"], r["seq"])):
        got[r["s"]] = got.get(r["s"], "") + r["piece"]
    known = dict(rules)
    assert got == {s: model.replace_all(t, {k: known[k] for k in known if k in t}) for s, t in texts.items()}


# ---- event lines -------------------------------------------------------------------------------------------------


def event_lines(text, provider, size=7):
    """A text as events, with lines around them that are passed on as they are."""
    lines = [": ping", "event: x", "data: not json", "data:[1]", ""]
    for i in range(0, len(text), size):
        piece = text[i:i + size]
        if provider == "anthropic":
            lines.append("data: " + json.dumps({"type": "content_block_delta", "index": 2, "delta": {"type": "text_delta", "text": piece}, "n": 1.0}))
        else:
            other = {"index": 1, "text": piece, "delta": {"tool_calls": [{"index": 3, "function": {"arguments": piece}}]}}
            lines.append("data:" + json.dumps({"choices": [{"index": 0, "delta": {"content": piece}}, other], "x": [1.5, None]}))
        lines.append("")
    return [*lines, "data: [DONE]"]


def texts_of(lines):
    out = {}
    for line in lines:
        if line.startswith("data:") and line[5:].strip()[:1] == "{":
            event = json.loads(line[5:])
            if "delta" in event:
                out["a"] = out.get("a", "") + event["delta"]["text"]
            for i, choice in enumerate(event.get("choices", ())):
                delta = choice.get("delta", {})
                for name, value in (("content", delta.get("content")), ("text", choice.get("text")),
                                    ("call", delta["tool_calls"][0]["function"]["arguments"] if "tool_calls" in delta else None)):
                    if value is not None:
                        out[f"{i}{name}"] = out.get(f"{i}{name}", "") + value
    return out


@pytest.mark.parametrize("provider", ["anthropic", "openai"])
def test_event_lines_written_back(spark, tmp_path, provider):
    texts = {f"s{i}": "".join(RANDOM.choices(PARTS, k=9)) + RANDOM.choice(["", *TOKENS, "__VAULT_J"]) for i in range(6)}
    lines = {s: event_lines(t, provider) for s, t in texts.items()}
    rows = [(s, i, line, i == len(v) - 1) for s, v in lines.items() for i, line in enumerate(v)]
    RANDOM.shuffle(rows)
    third = len(rows) // 3
    stream = feed(spark, tmp_path, [rows[:third], rows[third:2 * third] + rows[:9], rows[2 * third:]], "s string, seq long, line string, is_last boolean")
    vault = spark.createDataFrame(list(TOKENS.items()), "token string, secret string")
    out = str(tmp_path / "out")
    jobs.start_batches(jobs.sse_rewrite(stream, ["s"], provider), jobs.rewrite_to(vault, ["s"], out), str(tmp_path / "ck")).awaitTermination()
    got = {}
    for r in sorted(spark.read.parquet(out).collect(), key=lambda r: (r["s"], r["seq"], r["sub"])):
        got.setdefault(r["s"], []).append(r)
    for s, text in texts.items():
        written = [r["line"] for r in got[s] if not r["synthetic"]]
        plain = [i for i, line in enumerate(lines[s]) if "{" not in line]
        assert len(written) == len(lines[s]) and [written[i] for i in plain] == [lines[s][i] for i in plain]
        whole = texts_of([r["line"] for r in got[s]])
        assert set(whole.values()) == {model.replace_all(text, TOKENS)} and len(whole) == (1 if provider == "anthropic" else 3)
        rest = [r["line"] for r in got[s] if r["synthetic"]]
        assert rest[1::2] == [""] * (len(rest) // 2)
        for line in rest[::2]:  # in the shape of the last event, the other texts empty
            event = json.loads(line[6:])
            if provider == "anthropic":
                assert {**event, "delta": {**event["delta"], "text": ""}} == {"type": "content_block_delta", "index": 2, "n": 1, "delta": {"type": "text_delta", "text": ""}}
            else:
                assert sum(bool(t) for t in texts_of([line]).values()) == 1 and event["x"] == [1.5, None]


def test_event_lines_with_a_rule_list(spark, tmp_path):
    lines = event_lines("say hello to hel", "openai", 3)
    rows = [("s", i, line, i == len(lines) - 1) for i, line in enumerate(lines)]
    stream = feed(spark, tmp_path, [rows[:9], rows[9:]], "s string, seq long, line string, is_last boolean")
    got = drain(jobs.sse_replace(stream, ["s"], "openai", [("hello", 'B"Y'), ("x", "")]), tmp_path).orderBy("seq", "sub").collect()
    assert set(texts_of([r["line"] for r in got]).values()) == {'say B"Y to hel'}


# ---- response events ---------------------------------------------------------------------------------------------


def chat_lines(rng):
    def data(choice):
        return "data: " + json.dumps({"choices": [choice]})

    lines = ["", ": x", "data: nonsense", data("no object")]
    for _ in range(rng.randint(3, 14)):
        delta = {}
        if rng.random() < 0.6:
            delta["content"] = rng.choice(["", "ab", 'é"\n'])
        if rng.random() < 0.6:
            delta["tool_calls"] = [{**({"index": i} if rng.random() < 0.8 else {}), **({"id": f"c{i}"} if rng.random() < 0.5 else {}),
                                    "function": {**({"name": f"f{i}"} if rng.random() < 0.4 else {}), "arguments": rng.choice(['{"a"', ":1}", ""])}}
                                   for i in range(rng.randint(1, 2))]
        lines.append(data({"delta": delta, "finish_reason": None}))
    return lines + rng.choice([["data: [DONE]"], [data({"finish_reason": "stop"}), "data: [DONE]"], []])


@pytest.mark.parametrize("rows", [4096, 3])
def test_response_events_stream_equals_batch(spark, tmp_path, rows):
    rng = random.Random(rows)
    lines = [(f"s{s}", i, line, i == len(v) - 1) for s in range(12) for v in [chat_lines(rng)] for i, line in enumerate(v)]
    shuffled = rng.sample(lines, len(lines))
    schema = "s string, seq long, line string, is_last boolean"
    stream = feed(spark, tmp_path, [shuffled[:40], shuffled[40:80], shuffled[80:]], schema)
    got = drain(jobs.response_event_stream(stream, ["s"], rows, "m", 7), tmp_path)
    want = response_events(spark.createDataFrame(lines, schema), ["s"], "seq", "line", rows, "m", 7)

    def plain(frame):
        return sorted((tuple(r[c] for c in want.columns) for r in frame.collect()), key=str)

    assert plain(got) == plain(want)
    done = {r["s"]: r["response"] for r in got.where("type = 'response.completed'").collect()}
    assert len(done) == 12 and any(done.values())
    for text in filter(None, done.values()):
        response = json.loads(text)
        assert (response["status"], response["model"], response["created_at"]) == ("completed", "m", 7)
        messages = [x for x in response["output"] if x["type"] == "message"]
        assert response.get("output_text") == (messages[0]["content"][0]["text"] if messages else None)
    if rows == 3:
        assert not all(done.values())  # a stream of several segments has no object of any length


# ---- rules that follow the vault ---------------------------------------------------------------------------------


def test_rules_follow_the_vault(spark, tmp_path):
    chunk = "u string, id string, dir string, seq long, chunk string, is_last boolean"
    rule = "u string, secret string, token string, revision long"
    chunks = [[("a", "1", "in", 0, "one hunter2 hun", False), ("a", "2", "out", 1, "_JWT_12345678__", False), ("b", "1", "in", 0, "hunter2", True)],
              [("a", "1", "in", 1, "ter2 more hunter2", False), ("a", "2", "out", 0, "see __VAULT", False)],
              [("a", "1", "in", 2, " end hunter2", True), ("a", "2", "out", 2, " and __VAULT_JWT_12345678__", True), ("a", "1", "in", 2, "again", True)]]
    rules = [[("a", "zzz", "__VAULT_JWT_00000000__", 1)], [("a", "hunter2", "__VAULT_JWT_12345678__", 2)], [("a", "zzz", None, 3), ("a", "hunter2", "old", 0)]]
    stream = feed(spark, tmp_path / "c", chunks, chunk)
    changes = feed(spark, tmp_path / "r", rules, rule)
    rows = drain(jobs.rule_following_stream(stream, changes, ["u"], ["id"], "dir"), tmp_path).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["u"], r["stream"], r["seq"], r["synthetic"])):
        got[(r["u"], r["stream"])] = got.get((r["u"], r["stream"]), "") + r["piece"]
    token = "__VAULT_JWT_12345678__"
    # Text given out before the rule came stays; what comes from its batch on follows it, each user by their own rules.
    assert got == {("a", "1"): f"one hunter2 hunter2 more {token} end {token}", ("a", "2"): "see hunter2 and hunter2", ("b", "1"): "hunter2"}


# ---- terminal output ---------------------------------------------------------------------------------------------


def test_terminal_output_over_any_chunks(spark, tmp_path):
    colour = ["\x1b[0m", "\x1b[31;1m", "\x1b[2K"]
    torn = ["".join(c + (RANDOM.choice(colour) if RANDOM.random() < 0.3 else "") for c in t) for t in TOKENS]
    texts = {f"s{i}": "".join(RANDOM.choices([*PARTS, *colour, *torn], k=8)) for i in range(30)}
    texts |= {"open": "x " + torn[0] + "\x1b[12", "bad": "a " + torn[1] + " \x1bZ " + torn[0] + " tail", "end": "b" + torn[0], "esc": "y\x1b"}
    chunks = [(s, i // 5, t[i:i + 5], i + 5 >= len(t)) for s, t in texts.items() for i in range(0, len(t), 5)]
    RANDOM.shuffle(chunks)
    schema = "s string, seq long, chunk string, is_last boolean"
    half = len(chunks) // 2
    stream = feed(spark, tmp_path, [chunks[:half], chunks[half:]], schema)
    vault = spark.createDataFrame(list(TOKENS.items()), "token string, secret string")
    out = str(tmp_path / "out")
    jobs.start_batches(jobs.ansi_pieces(stream, ["s"]), jobs.restore_ansi_to(vault, ["s"], out), str(tmp_path / "ck")).awaitTermination()
    got = {}
    for r in sorted(spark.read.parquet(out).collect(), key=lambda r: (r["s"], r["seq"], r["sub"])):
        got[r["s"]] = got.get(r["s"], "") + r["restored"]
    whole = spark.createDataFrame(list(texts.items()), "s string, text string")
    want = {r["s"]: r["restored"] for r in restore_ansi(whole, vault, ["s"], "text", "restored").collect()}
    assert got == want and any(v in got["bad"] for v in TOKENS.values())
    visible = spark.createDataFrame([(got["open"],)], "t string").select(strip_ansi("t")).first()[0]
    assert TOKENS["__VAULT_JWT_12345678__"] in visible


def test_terminal_pieces_never_end_inside_an_escape():
    piece, held, raw = AnsiTokenHold().cut("", "ab\x1b[3")
    assert (piece, held, raw) == ("ab", "\x1b[3", False)
    assert AnsiTokenHold().cut(held, "1mc")[:2] == ("\x1b[31mc", "")


# ---- turns out of order ------------------------------------------------------------------------------------------


def test_turns_over_batches_and_late_ones(spark, tmp_path):
    texts = {s: [RANDOM.choice(["ab __VAULT_JWT_12345678__ c", "x", "", "long text of a turn", "pw = hunter2"]) for _ in range(30)] for s in "pqr"}
    rows = [(s, i, t) for s, v in texts.items() for i, t in enumerate(v)]
    late = ("p", 3, texts["p"][3])
    rest = [r for r in rows if r != late]
    rest.sort(key=lambda r: r[1] + 8 * RANDOM.random())
    early = [r for r in rest if r[0] == "p" and r[1] < 25]
    rest = [r for r in rest if r not in early]
    batches = [early[::-1] + rest[:20], rest[20:40], [*rest[40:], late, *early[:4]]]
    stream = feed(spark, tmp_path, batches, "s string, turn long, text string")
    windows = jobs.ordered_window_stream(stream, ["s"], "turn", "text", patience=20, window=25)
    out, side = str(tmp_path / "o"), str(tmp_path / "side")
    jobs.start_batches(windows, jobs.apart(out, side), str(tmp_path / "ck")).awaitTermination()
    got = {(r["s"], r["seq"]): r["window_text"] for r in spark.read.parquet(out).collect()}
    assert [(r["s"], r["seq"], r["text"]) for r in spark.read.parquet(side).collect()] == [late]
    from veilframe.operators.sessions import window_text

    on_time = spark.createDataFrame([r for r in rows if r != late], "s string, turn long, text string")
    want = {(r["s"], r["turn"]): r["window_text"] for r in window_text(on_time, ["s"], "turn", "text", window=25).collect()}
    assert got == want


# ---- the response side of traffic --------------------------------------------------------------------------------


def exchanges(spark, provider):
    texts = ["".join(RANDOM.choices(PARTS, k=8)) + RANDOM.choice(["", *TOKENS]) for _ in range(9)]
    kinds = [["text/event-stream"], ["application/json; x"], ["image/png"]]
    bodies = ["\n".join(event_lines(t, provider)) if i % 3 == 0 else t for i, t in enumerate(texts)]
    bodies[3] += "\n"  # a stream that ends with a line end
    rows = [(i, {"content-type": kinds[i % 3]}, b) for i, b in enumerate(bodies)] + [(20, None, None), (21, {"content-type": ["text/event-stream"]}, ""), (22, {}, texts[0])]
    responses = spark.createDataFrame(rows, "x long, headers map<string,array<string>>, body string")
    asked = [(r[0], f"/{provider}/v1/messages" if r[0] != 6 else "/health", {}) for r in rows]
    return texts, bodies, spark.createDataFrame(asked, "x long, path string, headers map<string,array<string>>"), responses


@pytest.mark.parametrize("provider", ["anthropic", "openai"])
def test_responses_are_restored_by_their_form(spark, provider):
    from veilframe.plans.pipelines import restore_traffic

    texts, bodies, requests, responses = exchanges(spark, provider)
    vault = spark.createDataFrame(list(TOKENS.items()), "token string, secret string")
    got = {r["x"]: r for r in restore_traffic(requests, responses, vault, ["x"]).collect()}
    assert len(got) == 12
    for i, (text, body) in enumerate(zip(texts, bodies)):
        restored = model.replace_all(text, TOKENS)
        if i % 3 == 0 and i != 6:
            assert got[i]["form"] == "events" and set(texts_of(got[i]["restored_body"].split("\n")).values()) == {restored}
            plain = [line for line in body.split("\n") if "{" not in line and line]
            assert [line for line in got[i]["restored_body"].split("\n") if "{" not in line and line] == plain
        elif i % 3 == 1:
            assert (got[i]["form"], got[i]["restored_body"]) == ("text", restored)
        else:  # neither text nor of a known provider
            assert got[i]["restored_body"] == body
    assert (got[20]["restored_body"], got[21]["restored_body"]) == (None, "")
    assert got[22]["restored_body"] == model.replace_all(texts[0], TOKENS)  # no content type counts as text


def test_requests_and_responses_meet_over_batches(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    asked = [[(i, start + timedelta(seconds=i), "/openai/v1/chat/completions", {}) for i in part] for part in ([0, 3], [1], [2])]
    answered = [[(i, start + timedelta(seconds=i + 1), {"content-type": ["text/plain"]}, f"__VAULT_JWT_12345678__ {i}") for i in part] for part in ([1], [0, 2], [7])]
    requests = feed(spark, tmp_path / "a", asked, "x long, ts timestamp, path string, headers map<string,array<string>>")
    responses = feed(spark, tmp_path / "b", answered, "x long, ts timestamp, headers map<string,array<string>>, body string")
    vault = spark.createDataFrame([("__VAULT_JWT_12345678__", "s")], "token string, secret string")
    out = str(tmp_path / "out")
    jobs.start_batches(jobs.exchange_stream(requests, responses, ["x"]), jobs.restore_exchanges_to(vault, ["x"], out), str(tmp_path / "ck")).awaitTermination()
    got = {r["x"]: (r["provider"], r["restored_body"]) for r in spark.read.parquet(out).collect()}
    assert got == {i: ("openai", f"s {i}") for i in (0, 1, 2)}


def test_cells_of_a_body_leave_as_they_are_made():
    """A batch of bodies was taken apart as a whole before, so a worker's memory grew with the batch and with its bodies."""
    calls = []

    class Counted(TokenHold):
        def cut(self, held, text):
            calls.append(text)
            return super().cut(held, text)

    line = 'data: {"choices":[{"delta":{"content":"a __VA"}}]}'
    body = "\r\n".join([line] * 1000)
    cells = body_cells("openai", body, Counted())
    parts, pieces = next(cells)
    assert len(calls) == 1 and pieces == ["a "] and parts[-1].endswith("}\r\n")
    rest = list(cells)
    assert len(rest) == 1001 and rest[-3][0][-1].endswith("}\n") and rest[-2][1] == ["__VA"] and rest[-1] == (["\n"], [])


def test_lines_without_a_token_are_put_together_in_place(spark, monkeypatch, tmp_path):
    from veilframe.streaming import jobs

    taken, restore = [], jobs.restore
    monkeypatch.setattr(jobs, "restore", lambda cells, *rest: taken.append(cells.count()) or restore(cells, *rest))
    token = "__VAULT_JWT_00000001__"
    batch = spark.createDataFrame(
        [("s", 0, 0, ["<", ">"], ["plain"], False), ("s", 1, 0, ["<", ">"], [token], False), ("s", 2, 0, ["data: [DONE]"], [], False),
         ("s", 3, 0, ["<", "|", ">"], ["a", None], True)],
        "k string, seq long, sub int, parts array<string>, pieces array<string>, synthetic boolean")
    vault = spark.createDataFrame([(token, "hidden")], "token string, secret string")
    jobs.rewrite_to(vault, ["k"], str(tmp_path))(batch, 0)
    lines = {r["seq"]: r["line"] for r in spark.read.parquet(str(tmp_path)).collect()}
    assert taken == [2] and len(lines) == 4 and lines[2] == "data: [DONE]"
    assert "plain" in lines[0] and "hidden" in lines[1] and token not in lines[1] and lines[3].startswith("<")
