"""Cutters: they take a text piece by piece and give out what later pieces can no longer change.

``cut(held, text)`` takes what was held back and the next text, and gives a finished piece and what is held back now;
``last(held)`` finishes what is left. Pieces put together are the whole text, or the whole text replaced.
"""

from __future__ import annotations

import json
import re

import ahocorasick
from pyspark import SparkFiles

from veilframe.functions import rules
from veilframe.operators.chunks import BODY, TOKEN_ROOM, UNFINISHED

_OPEN = re.compile(UNFINISHED.replace(r"\z", r"\Z"))
_BODY_BEFORE = re.compile(rf"{BODY}_?\Z")


def open_token(text: str) -> int:
    """Where a token begins that the end of ``text`` may leave unfinished, with the run of tokens before it that share
    underscores with each other; the length of ``text`` if there is none.

    A token is no longer than ``TOKEN_ROOM``, so the last one is looked for there; from it the run is followed back token by
    token, however long it is.
    """
    room = max(0, len(text) - TOKEN_ROOM)
    if text.find("_", room) < 0:  # what most pieces look like; nothing else of a token can stand alone
        return len(text)
    hit = _OPEN.search(text, room)
    if not hit:
        return len(text)
    at = hit.start()
    while before := _BODY_BEFORE.search(text, max(0, at - TOKEN_ROOM), at):
        at = before.start()
    return at


class TokenHold:
    """Cuts text where no token can be torn; knows the grammar only, so it works with a vault of any size."""

    def cut(self, held: str, text: str) -> tuple[str, str]:
        text = held + text
        at = open_token(text)
        return text[:at], text[at:]

    def last(self, held: str) -> str:
        return held


_BUILT: dict[int | str, tuple] = {}


class Dictionary:
    """Replaces the sources of a rule list: leftmost, longest at a place, without overlaps.

    An automaton finds all occurrences in one pass. An occurrence that starts before every suffix of the text which begins
    some longer source is final: nothing that comes can lengthen it or put another before it. Text from the first such
    suffix on is held back. The automaton is built once per worker, for lists of the same content.
    """

    def __init__(self, pairs: list[tuple[str, str]] | None = None, file: str | None = None) -> None:
        """A list of (source, target), or the name of a file of them that was sent to all workers (JSON lines)."""
        self.pairs, self.file = None if file else sorted((s, t) for s, t in dict(pairs).items() if s), file
        self.key = file or hash(tuple(self.pairs))

    def _automaton(self) -> tuple:
        """The automaton (values: length, target, whether a longer source begins with this one), the longest source's length, first letters."""
        if self.key not in _BUILT:
            pairs = self.pairs
            if self.file:
                with open(SparkFiles.get(self.file), encoding="utf-8") as lines:
                    pairs = sorted({r["source"]: r["target"] for r in map(json.loads, lines) if r["source"]}.items())
            machine = ahocorasick.Automaton()
            for i, (source, target) in enumerate(pairs):
                longer = i + 1 < len(pairs) and pairs[i + 1][0].startswith(source)
                machine.add_word(source, (len(source), target, longer))
            machine.make_automaton()
            if len(_BUILT) >= 64:
                _BUILT.pop(next(iter(_BUILT)))
            _BUILT[self.key] = machine, max((len(s) for s, _ in pairs), default=0), {s[0] for s, _ in pairs}
        return _BUILT[self.key]

    def _held_from(self, text: str, at: int) -> int:
        """The first place from ``at`` on whose rest of the text begins a source that is longer."""
        machine, longest, heads = self._automaton()
        for i in range(max(at, len(text) - longest + 1), len(text)):
            if text[i] in heads:
                rest = text[i:]
                if machine.match(rest) and machine.get(rest, (0, "", True))[2]:
                    return i
        return len(text)

    def _run(self, text: str, more: bool) -> tuple[str, str]:
        if not text or not self._automaton()[1]:
            return text, ""
        longest: dict[int, tuple[int, str]] = {}
        for end, (size, target, _) in self._automaton()[0].iter(text):
            start = end + 1 - size
            if size > longest.get(start, (0, ""))[0]:
                longest[start] = size, target
        out, at = [], 0
        limit = self._held_from(text, 0) if more else len(text)
        for start in sorted(longest):
            if start < at:
                continue
            if start >= limit:
                break
            size, target = longest[start]
            out += [text[at:start], target]
            at = start + size
            if at > limit:
                limit = self._held_from(text, at) if more else len(text)
        out.append(text[at:limit])
        return "".join(out), text[limit:]

    def cut(self, held: str, text: str) -> tuple[str, str]:
        return self._run(held + text, True)

    def last(self, held: str) -> str:
        return self._run(held, False)[0]


_SEQUENCE = re.compile(rules.CSI)
_BROKEN = re.compile(r"\x1B(?!\[)[\s\S]")


class AnsiTokenHold:
    """As ``TokenHold`` on the visible text of terminal output. Two states: escapes are read, or, behind an escape that is no
    control sequence, nothing is any more: ``raw`` says that a piece lies there and is not to be restored.

    Held back are an escape that is not finished, and the raw text from a token that the visible text may leave unfinished,
    with the escapes inside it.
    """

    def cut(self, held: str, text: str) -> tuple[str, str, bool]:
        """The piece, what is held back, and whether all that follows is raw."""
        text = held + text
        if "\x1b" not in text:
            at = open_token(text)
            return text[:at], text[at:], False
        broken = _BROKEN.search(text)
        if broken:  # the piece ends with the broken escape, so that what stands before it is still restored
            return text[:broken.end()], text[broken.end():], True
        whole, starts, at = [], [], 0
        end = len(text)
        while (escape := text.find("\x1b", at)) >= 0:
            whole.append(text[at:escape])
            starts.append((at, escape))
            done = _SEQUENCE.match(text, escape)
            if not done:
                end = escape
                break
            at = done.end()
        else:
            whole.append(text[at:])
            starts.append((at, len(text)))
        visible = "".join(whole)
        safe = open_token(visible)
        if safe == len(visible):
            return text[:end], text[end:], False
        for lo, hi in starts:
            if safe < hi - lo:
                return text[:lo + safe], text[lo + safe:], False
            safe -= hi - lo
        return text[:end], text[end:], False
