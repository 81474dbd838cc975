"""Stateful processors for streams of pieces.

``OrderedStream`` brings the rows of a stream into ``seq`` order, whatever micro-batch they come in, and hands them one by one to
a handler, whose own state is a small JSON text. A stream has one state value, read and written once per micro-batch; only
rows that came early take an entry each. ``DealtStreams`` does the same for streams that do not expire, many in a group: a call to the
state store takes about a millisecond, as long as tens of rows, so there a micro-batch makes a few calls for each group, not for each stream.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilframe.config import DETECTION_WINDOW
from veilframe.functions import rules
from veilframe.streaming.cutters import Dictionary

CLOSED_MS = 24 * 60 * 60 * 1000
BLOCK = 1024  # numbers of rows that are stored together while they wait
BLOCKS = 8  # blocks of a stream held in memory while a micro-batch runs; others go to the state store
GROUPS = 1024  # that streams are dealt to by hash; a checkpoint holds for one number of them
PACK = 4096  # rows that leave a processor as one row of lists
INLINE = 256  # rows of a stream that wait inside its entry; more go to blocks
NAMED = json.JSONEncoder(default=str).encode  # made once: ``json.dumps`` makes an encoder in every call that names a default
HELD = 1 << 16  # rows of a group that wait in memory while a micro-batch runs; beyond, they go to blocks


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that processors with several state variables need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Handler:
    """What is done with the rows of a stream, in order. ``fields`` are the input columns it reads besides ``seq`` and
    ``is_last``; they must be texts, numbers or arrays of them. ``state`` is JSON."""

    fields: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        """Open state of its own, for what grows with the stream."""

    def open(self, key: tuple) -> Any:
        return {}

    def take(self, key: tuple, state: Any, seq: int, row: list) -> Iterable[tuple]:
        raise NotImplementedError

    def end(self, key: tuple, state: Any, seq: int) -> Iterable[tuple]:
        """What is left when the stream ends; ``seq`` is that of its last row."""
        return ()

    def late(self, key: tuple, state: Any, seq: int, row: list) -> Iterable[tuple]:
        """A row that came after its place had been given up."""
        return ()

    def keep(self, stream: str, state: Any) -> None:
        """Called once before ``state`` is stored, at the end of a micro-batch. ``stream`` tells streams of a group apart in state of
        its own."""


class Early:
    """Rows that wait for one before them, in blocks of neighbouring numbers: a state call per block, not per row."""

    def __init__(self, store, stored: list[int], rows: dict[str, list] | None = None) -> None:
        """``rows`` wait besides those of the blocks ``stored``."""
        self.store, self.stored = store, set(stored)
        self.blocks: dict[int, dict[str, list]] = {}
        self.changed: set[int] = set()
        for seq, (values, last) in (rows or {}).items():
            self.put(int(seq), values, last)

    def _block(self, number: int) -> dict[str, list]:
        if number not in self.blocks:
            self.blocks[number] = json.loads(self.store.getValue((number,))[0]) if number in self.stored else {}
            if len(self.blocks) > BLOCKS:
                self._write(next(n for n in sorted(self.blocks, reverse=True) if n != number))
        return self.blocks[number]

    def _write(self, number: int) -> None:
        rows = self.blocks.pop(number)
        if number not in self.changed:
            return
        self.changed.discard(number)
        if rows:
            self.store.updateValue((number,), (json.dumps(rows),))
            self.stored.add(number)
        elif number in self.stored:
            self.store.removeKey((number,))
            self.stored.discard(number)

    def put(self, seq: int, values: list, last: bool) -> bool:
        """Whether the row is new."""
        rows = self._block(seq // BLOCK)
        if str(seq) in rows:
            return False
        rows[str(seq)] = [values, last]
        self.changed.add(seq // BLOCK)
        return True

    def pop(self, seq: int) -> list | None:
        number = seq // BLOCK
        if number not in self.blocks and number not in self.stored:
            return None
        found = self._block(number).pop(str(seq), None)
        if found:
            self.changed.add(number)
        return found

    def first(self) -> int | None:
        """The least number that waits."""
        for number in sorted({*self.blocks, *self.stored}):
            if rows := self._block(number):
                return min(map(int, rows))
        return None

    def keep(self) -> list[int]:
        for number in list(self.blocks):
            self._write(number)
        return sorted(self.stored)

    def few(self) -> dict[str, list] | None:
        """All rows that wait, if they are few and none is stored."""
        if self.stored or sum(map(len, self.blocks.values())) > INLINE:
            return None
        return {seq: row for rows in self.blocks.values() for seq, row in rows.items()}


class Place:
    """Where a stream stands: the number expected next, the rows that wait (``n_early`` of them), the places given up ([from, to)
    pairs), and the handler's state."""

    def __init__(self, handler: Handler, key: tuple, early: Early, state: Any, expected: int = 0, n_early: int = 0, gaps: list | None = None) -> None:
        self.handler, self.key, self.early, self.state = handler, key, early, state
        self.expected, self.n_early, self.gaps, self.done = expected, n_early, gaps or [], False

    def run(self, values: list | None) -> Iterator[tuple]:
        """Take ``values`` as the row expected, then those that wait behind it."""
        while not self.done:
            if values is None:
                values = self.early.pop(self.expected) if self.n_early else None
                if values is None:
                    return
                self.n_early -= 1
            yield from self.handler.take(self.key, self.state, self.expected, values[0])
            self.expected, self.done, values = self.expected + 1, values[1], None

    def push(self, seq: int, values: list) -> Iterator[tuple]:
        if self.done:
            return
        if seq == self.expected:
            yield from self.run(values)
        elif seq > self.expected:
            self.n_early += self.early.put(seq, *values)
        elif hole := next((g for g in self.gaps if g[0] <= seq < g[1]), None):  # given up before: no longer missing, but late
            self.gaps.remove(hole)
            self.gaps += [g for g in ([hole[0], seq], [seq + 1, hole[1]]) if g[0] < g[1]]
            yield from self.handler.late(self.key, self.state, seq, values[0])

    def give_up(self, patience: int | None) -> Iterator[tuple]:
        while patience is not None and not self.done and self.n_early > patience:
            first = self.early.first()
            self.gaps.append([self.expected, first])
            self.expected = first
            yield from self.run(None)


class OrderedStream(StatefulProcessor):
    """Rows of a stream in ``seq`` order (0, 1, 2 …), through a handler; output rows are the key columns and the handler's.

    A row of a number already taken is a repeated delivery and is dropped. A missing row holds later ones back: without end,
    or until more than ``patience`` rows wait for it at the end of a micro-batch. Then its place is given up, and if it still comes it goes to the
    handler as late. A stream that hears nothing for ``idle_ms`` is closed: what waits is taken in order, then what is left
    comes out. A closed stream is remembered, so that what is delivered again, or too late, is not taken for a new stream:
    for ``closed_ms`` where time is kept (``idle_ms`` given), else for as long as the query runs, which is meant for finite
    inputs.
    """

    def __init__(self, names: list[str], handler: Handler, idle_ms: int | None = None, patience: int | None = None,
                 closed_ms: int = CLOSED_MS) -> None:
        self.names, self.handler = names, handler
        self.idle_ms, self.patience, self.closed_ms = idle_ms, patience, closed_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # ``n_early`` rows wait in ``blocks`` (their numbers); ``gaps`` are places given up: [from, to) pairs. Both are JSON.
        self.stream = handle.getValueState(
            "stream", "next_seq long, timer long, n_early long, blocks string, gaps string, body string, closed boolean")
        self.early = handle.getMapState("early", "block long", "rows string")
        self.ended = handle.getValueState("ended", "seq long", self.closed_ms) if self.idle_ms is not None else None
        self.handler.init(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.stream.exists()
        expected, timer, n_early, blocks, gaps, body, closed = self.stream.get() if known else (0, 0, 0, "[]", "[]", None, False)
        if closed or self.ended is not None and not known and self.ended.exists():
            for _ in rows:
                pass
            return
        place = Place(self.handler, key, Early(self.early, json.loads(blocks)), json.loads(body) if known else self.handler.open(key),
                      expected, n_early, json.loads(gaps))
        for row in rows:
            yield from self._out(key, place.push(int(row["seq"]), [[row[f] for f in self.handler.fields], bool(row["is_last"])]))
        yield from self._out(key, place.give_up(self.patience))
        if place.done:
            if timer:
                self.handle.deleteTimer(timer)
            yield from self._close(key, place.state, place.expected, bool(place.early.stored))
            return
        if self.idle_ms is not None:
            if timer:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self.handler.keep("", place.state)
        self.stream.update((place.expected, timer, place.n_early, json.dumps(place.early.keep()), json.dumps(place.gaps),
                            json.dumps(place.state), False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        expected, _, n_early, blocks, _, body, _ = self.stream.get()
        state, blocks = json.loads(body), json.loads(blocks)
        early = Early(self.early, blocks)
        while n_early:
            seq = early.first()
            yield from self._out(key, self.handler.take(key, state, seq, early.pop(seq)[0]))
            expected, n_early = seq + 1, n_early - 1
        yield from self._close(key, state, expected, bool(blocks))

    def _out(self, key: tuple, rows: Iterable[tuple]) -> Iterator[Row]:
        made = Row(*self.names)
        for row in rows:
            yield made(*key, *row)

    def _close(self, key, state, expected: int, waited: bool) -> Iterator[Row]:
        yield from self._out(key, self.handler.end(key, state, expected - 1))
        if waited:
            self.early.clear()
        if self.ended is not None:
            self.ended.update((expected,))
            self.stream.clear()
        else:
            self.stream.update((expected, 0, 0, "[]", "[]", "{}", True))

    def close(self) -> None:
        pass


class _Blocks:
    """The blocks of one stream among those of its group."""

    def __init__(self, store, stream: str) -> None:
        self.store, self.stream = store, stream

    def getValue(self, number: tuple) -> tuple:
        return self.store.getValue((self.stream, *number))

    def updateValue(self, number: tuple, rows: tuple) -> None:
        self.store.updateValue((self.stream, *number), rows)

    def removeKey(self, number: tuple) -> None:
        self.store.removeKey((self.stream, *number))


def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the same first column, one row of lists for each batch: handing a row to a processor costs more than what is done
    with it."""
    for batch in batches:
        if batch.num_rows:
            groups = batch.column(0).to_numpy()
            order = np.argsort(groups, kind="stable")
            starts = np.flatnonzero(np.diff(groups[order], prepend=-1))
            offsets, taken = pa.array(np.append(starts, len(order)), pa.int32()), batch.take(pa.array(order))
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups[order][starts]), *[pa.ListArray.from_arrays(offsets, c) for c in taken.columns[1:]]], names=batch.schema.names)


class DealtStreams(StatefulProcessor):
    """``OrderedStream`` for a group of streams that do not expire; ``keys`` are the input columns that tell them apart.

    Rows come and go in packs (see ``packed``): a row of lists. What is known of all open streams of a group is read and written as one list; rows that wait lie in it while they are few, else in
    blocks of their own. Closed streams are remembered by name, in one list entry for each micro-batch.
    """

    def __init__(self, names: list[str], keys: list[str], handler: Handler, patience: int | None = None) -> None:
        self.names, self.keys, self.handler, self.patience = names, keys, handler, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "stream string, next_seq long, n_early long, blocks string, rows string, gaps string, body string")
        self.closed = handle.getListState("closed", "streams string")
        self.early = handle.getMapState("early", "stream string, block long", "rows string")
        self.handler.init(handle)

    def _place(self, stream: str, key: tuple, entry: tuple | None) -> Place:
        if entry is None:
            return Place(self.handler, key, Early(_Blocks(self.early, stream), []), self.handler.open(key))
        expected, n_early, blocks, rows, gaps, body = entry
        early = Early(_Blocks(self.early, stream), json.loads(blocks), json.loads(rows))
        return Place(self.handler, key, early, json.loads(body), expected, n_early, json.loads(gaps))

    def _entry(self, stream: str, place: Place) -> tuple:
        self.handler.keep(stream, place.state)
        few = place.early.few()
        blocks = [] if few is not None else place.early.keep()
        return (stream, place.expected, place.n_early, json.dumps(blocks), json.dumps(few or {}), json.dumps(place.gaps), json.dumps(place.state))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        out: list[tuple] = []
        for made in self._made(rows):
            out.append(made)
            if len(out) >= PACK:
                yield Row(*self.names)(*map(list, zip(*out)))
                out = []
        if out:
            yield Row(*self.names)(*map(list, zip(*out)))

    def _load(self) -> None:
        """What is known of the group; ``streams`` are the names of keys met, ``held`` the rows that wait in memory."""
        self.entries = {e[0]: tuple(e[1:]) for e in self.open.get()}
        self.gone = {stream for e in self.closed.get() for stream in json.loads(e[0])}
        self.places: dict[str, Place] = {}
        self.streams: dict[tuple, str] = {}
        self.held = 0

    def _at(self, own: tuple) -> Place | None:
        """The place of the stream with these keys; None if it is closed."""
        stream = self.streams.get(own)
        if stream is None:
            stream = self.streams[own] = NAMED(own)
        if stream in self.gone:
            return None
        place = self.places.get(stream)
        if place is None:
            place = self.places[stream] = self._place(stream, own, self.entries.get(stream))
            self._hold(place.n_early)
        return place

    def _hold(self, more: int) -> None:
        self.held += more
        if self.held > HELD:
            for place in self.places.values():
                place.early.keep()
            self.held = 0

    def _made(self, rows) -> Iterator[tuple]:
        self._load()
        n = len(self.keys)
        for pack in rows:
            for row in zip(*tuple(pack)[1:]):  # keys, seq, is_last, fields
                place = self._at(row[:n])
                if place is None:
                    continue
                before, values = place.n_early, [list(row[n + 2:]), bool(row[n + 1])]
                if row[n] > place.expected and not place.done:  # most rows of a stream out of order: no generator for what only waits
                    place.n_early += place.early.put(row[n], *values)
                else:
                    for out in place.push(row[n], values):
                        yield *place.key, *out
                if place.n_early != before:
                    self._hold(place.n_early - before)
        yield from self._keep()

    def _keep(self) -> Iterator[tuple]:
        ended = []
        for stream, place in self.places.items():
            for out in place.give_up(self.patience):
                yield *place.key, *out
            if not place.done:
                self.entries[stream] = self._entry(stream, place)[1:]
                continue
            for out in self.handler.end(place.key, place.state, place.expected - 1):
                yield *place.key, *out
            for number in place.early.stored:
                self.early.removeKey((stream, number))
            self.entries.pop(stream, None)
            ended.append(stream)
        if self.entries:
            self.open.put([(stream, *entry) for stream, entry in self.entries.items()])
        elif ended:
            self.open.clear()
        if ended:
            self.closed.appendValue((json.dumps(ended),))

    def close(self) -> None:
        pass


class Fields(Handler):
    """Every text field of a stream through a cutter: (seq, field_key, piece, synthetic). What is left at the end comes as
    synthetic rows. ``pick`` chooses the cutter by the stream's key, e.g. by direction."""

    fields = ["field_keys", "field_values"]

    def __init__(self, cutters: dict, pick: int | None = None) -> None:
        self.cutters, self.pick = cutters, pick

    def _cutter(self, key: tuple):
        return self.cutters[key[self.pick] if self.pick is not None else None]

    def take(self, key, state, seq, row):
        cutter = self._cutter(key)
        for name, value in zip(*row):
            piece, held = cutter.cut(state.pop(name, ""), value or "")
            if held:
                state[name] = held
            yield seq, name, piece, False

    def end(self, key, state, seq):
        cutter = self._cutter(key)
        for name, held in state.items():
            yield seq, name, cutter.last(held), True


class _Followed(Handler):
    """Pieces through the dictionary of their scope and direction: (seq, piece, synthetic)."""

    fields = ["chunk"]

    def __init__(self) -> None:
        self.cutters: dict[tuple, Dictionary] = {}  # of all scopes with pieces in a micro-batch, by direction

    def open(self, key):
        return [""]

    def take(self, key, state, seq, row):
        piece, state[0] = self.cutters[key[:-2], key[-1] == "in"].cut(state[0], row[0] or "")
        yield seq, piece, False

    def end(self, key, state, seq):
        if state[0]:
            yield seq, self.cutters[key[:-2], key[-1] == "in"].last(state[0]), True


class RuleFollowing(DealtStreams):
    """Streams of a scope (a session), replaced by rules that arrive while they run; a group holds many scopes.

    Input rows are rules (``secret``, ``token``, ``revision``) or pieces (``stream``, ``direction``, ``seq``, ``chunk``,
    ``is_last``) of their scope. What a micro-batch brings as rules holds for its pieces and all later ones, also for text
    that was held back. A secret or token given again is taken as its latest revision says; a rule without token is
    withdrawn. Text in direction ``in`` is masked, other text restored. Output: (stream, direction, seq, piece, synthetic).
    """

    def __init__(self, names: list[str], scope: list[str]) -> None:
        super().__init__(names, [*scope, "stream", "direction"], _Followed())

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.rules = handle.getListState("rules", "scope string, secret string, token string, revision long")

    def _made(self, rows) -> Iterator[tuple]:
        self._load()
        known: dict[str, dict[str, tuple]] = {}
        for scope, secret, *rule in self.rules.get():
            known.setdefault(scope, {})[secret] = tuple(rule)
        n, fresh, again = len(self.keys), {}, False
        for pack in rows:  # all rules of the batch come before its pieces, so pieces wait until all rows are read
            for row in zip(*tuple(pack)[1:]):  # keys, seq, is_last, chunk, secret, token, revision
                if row[n + 3] is not None:
                    scope, secret, rule = NAMED(row[:n - 2]), row[n + 3], row[n + 4:]
                    before = known.setdefault(scope, {}).get(secret)
                    if before is None or rule[1] >= before[1]:
                        again |= before is not None
                        known[scope][secret] = fresh[scope, secret] = rule
                elif (place := self._at(row[:n])) and row[n] >= place.expected:
                    new = place.early.put(row[n], [row[n + 2]], bool(row[n + 1]))
                    place.n_early += new
                    self._hold(new)
        if again:
            self.rules.put([(scope, secret, *rule) for scope, rules_ in known.items() for secret, rule in rules_.items()])
        elif fresh:
            self.rules.appendList([(*at, *rule) for at, rule in fresh.items()])
        self.handler.cutters = cutters = {}
        for place in sorted(self.places.values(), key=lambda p: NAMED(p.key[:-2])):
            at = place.key[:-2]
            if (at, True) not in cutters:
                pairs = sorted((s, t) for s, (t, _) in known.get(NAMED(at), {}).items() if t is not None)
                cutters[at, True] = Dictionary(pairs)
                cutters[at, False] = Dictionary([(t, s) for s, t in reversed(pairs)])  # of secrets that share a token the first in order counts
            for out in place.run(None):
                yield *place.key, *out
        yield from self._keep()


_LOOSE_TOKEN = re.compile(rules.TOKEN_LOOSE)


def without_tokens(text: str) -> str:
    bare = _LOOSE_TOKEN.sub("", text)
    at = bare.rfind(rules.TOKEN_HEAD)
    return bare if at < 0 else bare[:at]


class RollingWindow(StatefulProcessor):
    """Last characters of a session's text after every chunk, tokens left out also where chunks split them."""

    def __init__(self, key_names: list[str], order: str, text: str, window: int = DETECTION_WINDOW) -> None:
        self.key_names, self.order, self.text, self.window = key_names, order, text, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getValueState("buffer", "text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.buffer.get()[0] if self.buffer.exists() else ""
        # The rows of a micro-batch come in any order and in any number of Arrow batches: they are sorted as a whole.
        for batch in [pd.concat(list(rows)).sort_values(self.order, kind="stable")]:
            seen = []
            for chunk in batch[self.text]:
                held = without_tokens(held + (chunk or ""))[-self.window:]
                seen.append(held)
            yield pd.DataFrame({**{n: v for n, v in zip(self.key_names, key)}, self.order: batch[self.order].to_numpy(),
                                self.text: batch[self.text].to_numpy(), "window_text": seen})
        self.buffer.update((held,))

    def close(self) -> None:
        pass


class Windows(Handler):
    """The rolling detection text in the order of the turns, over any number of micro-batches: (seq, text, window_text, late).
    A turn that comes after its place was given up is late: it has no window, and goes to a side table."""

    fields = ["text"]

    def __init__(self, window: int = DETECTION_WINDOW) -> None:
        self.window = window

    def open(self, key):
        return [""]

    def take(self, key, state, seq, row):
        state[0] = without_tokens(state[0] + (row[0] or ""))[-self.window:]
        yield seq, row[0], state[0], False

    def late(self, key, state, seq, row):
        yield seq, row[0], None, True
