from __future__ import annotations

import json
import random
import re

import pytest

from veilframe.streaming import events
from veilframe.streaming.cutters import TokenHold


class Counted:
    """``re`` as the handler sees it, with a count of the patterns that are made."""

    def __init__(self) -> None:
        self.made = 0

    def __getattr__(self, name):
        def call(*args, **more):
            self.made += 1
            return getattr(re, name)(*args, **more)

        return call


def written(lines, provider="openai"):
    handler = events.Rewritten(TokenHold(), provider)
    state = handler.open(())
    out = [row for i, line in enumerate(lines) for row in handler.take((), state, i, [line])]
    return out + list(handler.end((), json.loads(json.dumps(state)), len(lines) - 1))


def test_a_line_makes_no_pattern_decoder_or_encoder(monkeypatch):
    """The work for a line is its own: what is the same for all lines is made once."""
    line = 'data: {"model":"m","choices":[{"index":0,"delta":{"content":"abc def"}}]}'
    counted = Counted()
    monkeypatch.setattr(events, "re", counted)
    monkeypatch.setattr(events.json, "JSONDecoder", None)
    monkeypatch.setattr(events.json, "JSONEncoder", None)
    assert [(parts, pieces) for _, _, parts, pieces, _ in written([line] * 5)] == [
        (['data: {"model":"m","choices":[{"index":0,"delta":{"content":', "}}]}"], ["abc def"])] * 5
    assert counted.made == 0


@pytest.mark.parametrize("text", ["plain", "é😀", 'quo"te \\ back', "\ud83d", "a\ud800b", "😀", "", "__VAULT_JWT_12345678__ x"])
def test_lines_written_back_are_the_event(text):
    """Surrogates that are no pair become the replacement character where they stay in a part, as before."""
    event = {"id": text, "n": 1.0, "f": 2.5, "choices": [{"index": 0, "delta": {"content": "x y"}, "text": "second"}]}
    (_, _, parts, pieces, synthetic), = written(["data: " + json.dumps(event)])
    assert not synthetic and pieces == ["x y", "second"]
    whole = "".join(part + (json.dumps(piece) if piece is not None else "") for part, piece in zip(parts, [*pieces, None]))
    want = json.loads(json.dumps(event)) | {"id": json.loads(json.dumps(text)).encode("utf-8", "surrogatepass").decode("utf-8", "replace"), "n": 1}
    assert json.loads(whole[len("data: "):]) == want


@pytest.mark.parametrize("payload", ['{"a":NaN}', '{"a":Infinity}', "[1]", "1", "", "{", "﻿{}", "null", "[" * 100_000])
def test_what_is_no_object_passes_as_it_is(payload):
    assert written(["data: " + payload]) == [(0, 0, ["data: " + payload], [], False)]


def test_numbers_read_as_json_has_them():
    rng = random.Random(2)
    for _ in range(200):
        value = rng.choice([rng.random(), float(rng.randrange(1000)), rng.randrange(1 << 40), 1e300, -0.0])
        got = events.parsed(json.dumps({"v": value}))["v"]
        assert got == value and isinstance(got, int) == (float(value).is_integer() and abs(value) < 1e21)
