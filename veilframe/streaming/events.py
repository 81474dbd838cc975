"""Handlers that keep the form of a stream: event lines written back, chat deltas re-shaped into response events, terminal output."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

from veilframe.operators.ordered import SEGMENT_ROWS
from veilframe.streaming.cutters import AnsiTokenHold
from veilframe.streaming.state import Handler


PAGE = 512  # pieces of a stream that ride in its state; more go to a page of their own


def _refuse(name: str):
    raise ValueError(name)


def parsed(payload: str):
    """A JSON object, or None. NaN and Infinity are no JSON; whole floats read as integers, as JSON has one kind of number."""
    try:
        found = _DECODE(payload)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _number(text: str):
    value = float(text)
    return int(value) if value.is_integer() and abs(value) < 1e21 else value


# Made once: ``json`` makes a decoder or an encoder in every call that names an option.
_DECODE = json.JSONDecoder(parse_constant=_refuse, parse_float=_number).decode
_ENCODE = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def compact(value) -> str:
    text = _ENCODE(value)
    if text.isascii():
        return text
    return text.encode("utf-8", "surrogatepass").decode("utf-8", "replace")


def _is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def text_slots(event: dict, provider: str) -> Iterator[tuple[str, dict, str]]:
    """The text fields of an event that may carry tokens: (key of the field over the stream, the object that holds it, its name).
    The keys are those of ``sse_text_fields``."""
    def slot(key: str, holder, name: str):
        if isinstance(holder, dict) and isinstance(holder.get(name), str):
            yield key, holder, name

    if provider == "anthropic":
        index = int(event["index"]) if _is_number(event.get("index")) else 0
        for part, name in (("delta", "text"), ("delta", "partial_json"), ("content_block", "text")):
            yield from slot(f"anthropic:{index}:{part}.{name}", event.get(part), name)
        yield from slot("anthropic:completion", event, "completion")
    elif provider == "openai" and isinstance(event.get("choices"), list):
        for place, choice in enumerate(event["choices"]):
            if not isinstance(choice, dict):
                continue
            index = int(choice["index"]) if _is_number(choice.get("index")) else place
            delta = choice["delta"] if isinstance(choice.get("delta"), dict) else {}
            yield from slot(f"openai:{index}:text", choice, "text")
            yield from slot(f"openai:{index}:delta.content", delta, "content")
            yield from slot(f"openai:{index}:delta.function_call.arguments", delta.get("function_call"), "arguments")
            calls = delta.get("tool_calls")
            for at, call in enumerate(calls if isinstance(calls, list) else ()):
                if isinstance(call, dict):
                    number = int(call["index"]) if _is_number(call.get("index")) else at
                    yield from slot(f"openai:{index}:delta.tool_calls.{number}.function.arguments", call.get("function"), "arguments")


_MARK = uuid.uuid4().hex  # of this worker; no event holds it, and none is given out with it
_MARKED = re.compile(f'"{_MARK}:([0-9]+)"')


class Rewritten(Handler):
    """Event lines with their text fields cut where no token is torn: (seq, sub, parts, pieces, synthetic).

    A line is part 0, piece 0 as a JSON string, part 1, piece 1 … and the last part; lines without a text field are one part.
    What a field holds back at the end of the stream comes as a line of its own, in the shape of the last event that had
    the field: that event with all other text fields empty. A blank line follows it, as after any event.
    """

    fields = ["line"]

    def __init__(self, cutter, provider: str) -> None:
        self.cutter, self.provider = cutter, provider

    def open(self, key):
        return {"held": {}, "shape": {}}

    def take(self, key, state, seq, row):
        line = row[0] or ""
        prefix = "data: " if line.startswith("data: ") else "data:"
        event = parsed(line[len(prefix):]) if line.startswith("data:") else None
        slots = list(text_slots(event, self.provider)) if event else []
        if not slots:
            yield seq, 0, [line], [], False
            return
        cut = []
        for at, (field, holder, name) in enumerate(slots):
            piece, state["held"][field] = self.cutter.cut(state["held"].get(field, ""), holder[name])
            cut.append((field, piece))
            holder[name] = f"{_MARK}:{at}"
        # Fields are written in the order of the event, which need not be the order they are looked up in.
        found = _MARKED.split(compact(event))
        parts, order = found[::2], [int(at) for at in found[1::2]]
        pieces = [cut[at][1] for at in order]
        for place, at in enumerate(order):  # with the other fields empty, what stands before and behind this one
            state["shape"][cut[at][0]] = ['""'.join(parts[:place + 1]), '""'.join(parts[place + 1:])]
        yield seq, 0, [prefix + parts[0], *parts[1:]], pieces, False

    def end(self, key, state, seq):
        sub = 0
        for field, held in state["held"].items():
            left = self.cutter.last(held)
            if left:
                before, behind = state["shape"][field]
                yield seq, sub + 1, ["data: " + before, behind], [left], True
                yield seq, sub + 2, [""], [], True
                sub += 2


def body_cells(provider: str, body: str, cutter) -> Iterator[tuple[list[str], list[str]]]:
    """A logged event-stream body as cells of a line each: parts and pieces as ``Rewritten`` gives them, line ends
    included. Line ends stay as they are; what is left over comes as events behind the last line. Cells come one by one, so
    that a body is never held as cells."""
    handler, lines = Rewritten(cutter, provider), body.split("\n")
    state = handler.open(())
    for at, line in enumerate(lines):
        text, more = line.removesuffix("\r"), at < len(lines) - 1
        (_, _, parts, pieces, _), = handler.take((), state, at, [text])
        left = [] if more else list(handler.end((), state, len(lines)))
        yield [*parts[:-1], parts[-1] + line[len(text):] + ("\n" if more or left and line else "")], pieces
    for _, _, parts, pieces, _ in left:
        yield [*parts[:-1], parts[-1] + "\n"], pieces


def record_id(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:12]


class Reshaped(Handler):
    """Chat deltas as response events, the same rows as ``response_events`` gives in batch.

    State are the tools met so far and running numbers; texts and arguments, which the closing events repeat, go to a map
    state in pages once they are many, at most one per micro-batch, and are read when the stream ends.
    """

    fields = ["line"]

    def __init__(self, rows: int = SEGMENT_ROWS, model: str | None = None, created_at: int | None = None) -> None:
        self.rows, self.model, self.created_at = rows, model, created_at

    def init(self, handle) -> None:
        self.texts = handle.getMapState("texts", "stream string, page long", "pieces string")

    def open(self, key):
        return {"started": False, "ended": False, "n_content": 0, "content": False, "tools": {}, "fresh": [], "stream": "", "pages": 0}

    def _event(self, phase, seq, sub, part, type_, index, item=None, text=None, name=None, call=None, segment=0, response=None):
        return phase, seq, sub, part, f"response.{type_}", index, item, text, name, call, segment, response

    def _response(self, key, **more) -> str:
        made = {"id": "resp_" + record_id(_joined(key)), "object": "response", "created_at": self.created_at, "model": self.model, **more}
        return compact({k: v for k, v in made.items() if v is not None})

    def take(self, key, state, seq, row):
        if not state["started"]:
            state["started"] = True
            yield self._event(0, 0, 0, 0, "created", 0, response=self._response(key, output=[], output_text="", status="in_progress"))
        line = row[0] or ""
        if not line.startswith("data: "):
            return
        done, event = line[6:] == "[DONE]", parsed(line[6:])
        choices = event.get("choices") if event else None
        choice = next((c for c in choices if isinstance(c, dict)), None) if isinstance(choices, list) else None
        if choice is not None:
            delta = choice["delta"] if isinstance(choice.get("delta"), dict) else {}
            done = done or choice.get("finish_reason") is not None
            content, sub = delta.get("content"), 0
            if isinstance(content, str) and content:
                yield from self._content(key, state, seq, content)
                sub = 1
            calls = delta.get("tool_calls")
            for at, call in enumerate([c for c in calls if isinstance(c, dict)] if isinstance(calls, list) else ()):
                yield from self._call(key, state, seq, sub + at, at, call)
        if done and not state["ended"]:
            yield from self._finish(key, state)

    def _content(self, key, state, seq, text):
        item = "msg_" + record_id(_joined(key))
        if not state["content"]:
            state["content"] = True
            yield self._event(1, seq, 0, 0, "output_item.added", 0, item)
            yield self._event(1, seq, 0, 1, "content_part.added", 0, item, "")
        yield self._event(1, seq, 0, 2, "output_text.delta", 0, item, text)
        if not state["ended"]:
            state["fresh"].append(["", state["n_content"], text])
            state["n_content"] += 1

    def _call(self, key, state, seq, sub, at, call):
        index = str(int(call["index"]) if _is_number(call.get("index")) else at)
        function = call["function"] if isinstance(call.get("function"), dict) else {}
        name = function["name"] if isinstance(function.get("name"), str) else None
        text = function["arguments"] if isinstance(function.get("arguments"), str) else ""
        tool = state["tools"].get(index)
        place = record_id(_joined((*key, index)))
        if tool is None:
            given = call["id"] if isinstance(call.get("id"), str) and call["id"] else f"call_{place}"
            tool = state["tools"][index] = {"call": given, "item": f"fc_{place}", "name": name, "out": len(state["tools"]) + state["content"], "n": 0}
            yield self._event(1, seq, sub, 0, "output_item.added", tool["out"], tool["item"], None, "tool" if name is None else name, given)
        if name:
            tool["name"] = name
        if text:
            yield self._event(1, seq, sub, 2, "function_call_arguments.delta", tool["out"], tool["item"], text)
        if not state["ended"]:
            state["fresh"].append([index, tool["n"], text])
            tool["n"] += 1

    def keep(self, stream, state) -> None:
        if len(state["fresh"]) > PAGE:
            self.texts.updateValue((stream, state["pages"]), (json.dumps(state["fresh"]),))
            state["stream"], state["pages"], state["fresh"] = stream, state["pages"] + 1, []

    def _kept(self, state) -> Iterator[list]:
        """The pieces of all pages, which are emptied, then those not yet kept."""
        for page in range(state["pages"]):
            at = (state["stream"], page)
            yield from json.loads(self.texts.getValue(at)[0])
            self.texts.removeKey(at)
        yield from state["fresh"]
        state["pages"], state["fresh"] = 0, []

    def _segments(self, state) -> dict[str, list[str]]:
        """Whole texts per item, in segments of so many deltas."""
        found: dict[str, dict[int, list[str]]] = {}
        for item, place, text in self._kept(state):
            found.setdefault(item, {}).setdefault(int(place) // self.rows, []).append(text)
        return {item: ["".join(parts[s]) for s in sorted(parts)] for item, parts in found.items()}

    def _finish(self, key, state):
        state["ended"] = True
        whole = self._segments(state)
        item, output = "msg_" + record_id(_joined(key)), []
        for segment, text in enumerate(whole.get("", ())):
            for part, type_ in enumerate(("output_text.done", "content_part.done", "output_item.done")):
                yield self._event(2, 0, 0, part, type_, 0, item, text, segment=segment)
        if "" in whole:
            output.append({"id": item, "type": "message", "role": "assistant", "status": "completed",
                           "content": [{"type": "output_text", "text": whole[""][0], "annotations": []}]})
        for index, tool in sorted(state["tools"].items(), key=lambda t: t[1]["out"]):
            name = "tool" if tool["name"] is None else tool["name"]
            for segment, text in enumerate(whole.get(index, ())):
                for part, type_ in enumerate(("function_call_arguments.done", "output_item.done")):
                    yield self._event(2, 1, tool["out"], part, type_, tool["out"], tool["item"], text, name, tool["call"], segment)
            output.append({"id": tool["item"], "type": "function_call", "call_id": tool["call"], "name": name,
                           "arguments": whole.get(index, [""])[0], "status": "completed"})
        short = all(len(s) == 1 for s in whole.values())
        yield self._event(3, 0, 0, 0, "completed", 0, response=self._response(
            key, output=output, output_text=whole[""][0] if "" in whole else None, status="completed") if short else None)

    def end(self, key, state, seq):
        if state["started"] and not state["ended"]:
            yield from self._finish(key, state)


def _joined(key) -> str:
    """As ``concat_ws`` joins the key columns."""
    return ":".join(str(k) for k in key if k is not None)


_ANSI = AnsiTokenHold()


class Terminal(Handler):
    """Terminal output cut where no visible token and no escape is torn: (seq, sub, piece, raw, synthetic). ``raw`` pieces lie
    behind a broken escape and are not to be restored."""

    fields = ["chunk"]

    def open(self, key):
        return ["", False]

    def take(self, key, state, seq, row):
        text = row[0] or ""
        if state[1]:
            yield seq, 0, text, True, False
            return
        piece, held, state[1] = _ANSI.cut(state[0], text)
        yield seq, 0, piece, False, False
        if state[1] and held:
            yield seq, 1, held, True, False
        state[0] = "" if state[1] else held

    def end(self, key, state, seq):
        if state[0]:
            yield seq, 2, state[0], False, True
