"""Exact duplicates by a tree merge of sorted digest runs.

Every task sorts the digests it has read into a run, in which a digest stands once with the identifier that stays and
the number of rows. In binomial rounds groups of ``FAN`` slots exchange their runs: a slot keeps the digests whose next
leading bits name it and sends the others to its partners, and each merges the runs it gets in one multiway pass. After
log(slots) rounds a slot holds one run, sorted, of its own digest range. Equal digests fold at every level, so a text
that fills a third of the table is one entry per task after the first level; no slot ever holds more than its range.
An entry is only folded into another when SHA-256, byte length and a second, independent 64-bit hash all agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import U64, free_name, lean
from veilframe.session import cut_lineage

FAN_BITS = 3
FAN = 1 << FAN_BITS
BLOCK = 4096
_NULL = np.iinfo(np.int64).min
_KEYS = 6  # 64-bit words of a key: four of the digest, the length, the second hash
_BLOCKS = "slot int, first binary, entries binary"
_MERGED = "sha binary, n_bytes bigint, check bigint, keep_id bigint, group_size bigint"


def _sorted_fold(entries: np.ndarray, largest: bool) -> np.ndarray:
    """Entries (key words, id, count) in key order, equal keys folded to the id that stays and the sum of counts."""
    if len(entries) == 0:
        return entries
    entries = entries[np.lexsort(entries[:, :_KEYS].T[::-1])]
    heads = np.flatnonzero(np.r_[True, (entries[1:, :_KEYS] != entries[:-1, :_KEYS]).any(axis=1)])
    out = entries[heads]
    ids = np.ascontiguousarray(entries[:, _KEYS]).view(np.int64)
    if largest:
        best = np.maximum.reduceat(ids, heads)
    else:  # null is the least long, and stays only where no row has an identifier
        best = np.minimum.reduceat(np.where(ids == _NULL, np.iinfo(np.int64).max, ids), heads)
        known = np.maximum.reduceat(ids, heads) != _NULL
        best = np.where(known, best, _NULL)
    out[:, _KEYS] = best.view(U64)
    out[:, _KEYS + 1] = np.add.reduceat(entries[:, _KEYS + 1], heads)
    return out


def _word_bytes(entries: np.ndarray) -> np.ndarray:
    return entries[:, :4].astype(">u8")


class _Sender:
    """Cuts sorted entries into blocks for the slots of the next round."""

    def __init__(self, slot: int, step: int, rounds: int) -> None:
        self.shift, self.slot, self.top = FAN_BITS * (rounds - 1 - step), slot, 64 - FAN_BITS * rounds
        self.waiting: dict[int, list[np.ndarray]] = {}
        self.held: dict[int, int] = {}

    def add(self, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        digit = ((entries[:, 0] >> U64(self.top)) >> U64(self.shift)) & U64(FAN - 1)
        for d in np.unique(digit):
            to = (self.slot & ~((FAN - 1) << self.shift)) | (int(d) << self.shift)
            self.waiting.setdefault(to, []).append(entries[digit == d])
            self.held[to] = self.held.get(to, 0) + len(self.waiting[to][-1])
            if self.held[to] >= BLOCK:
                yield from self.flush(to)

    def flush(self, to: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        for key in list(self.waiting) if to is None else [to]:
            run = np.concatenate(self.waiting.pop(key))
            self.held.pop(key)
            for i in range(0, len(run), BLOCK):
                yield key, run[i:i + BLOCK]


def _block_batch(blocks: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([s for s, _ in blocks], pa.int32()),
        pa.array([_word_bytes(e[:1]).tobytes() for _, e in blocks], pa.binary()),
        pa.array([np.ascontiguousarray(e).tobytes() for _, e in blocks], pa.binary())], ["slot", "first", "entries"])


def _batched(blocks: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, np.ndarray]] = []
    for block in blocks:
        held.append(block)
        if len(held) == 16:
            yield _block_batch(held)
            held = []
    if held:
        yield _block_batch(held)


def _first_runs(rounds: int, largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(TaskContext.get().partitionId() % FAN ** rounds, 0, rounds)

        def blocks() -> Iterator[tuple[int, np.ndarray]]:
            held, size = [], 0
            for batch in batches:
                n = batch.num_rows
                if n == 0:
                    continue
                entries = np.empty((n, _KEYS + 2), U64)
                sha = np.frombuffer(b"".join(batch.column("sha").to_pylist()), ">u8").reshape(n, 4)
                entries[:, :4] = sha
                entries[:, 4] = batch.column("n_bytes").to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
                entries[:, 5] = batch.column("check").to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
                entries[:, 6] = batch.column("id").fill_null(_NULL).to_numpy(zero_copy_only=False).view(U64)
                entries[:, 7] = 1
                held.append(entries)
                size += n
                if size >= 1 << 18:  # a run of its own: any number of runs per task may be merged later
                    yield from sender.add(_sorted_fold(np.concatenate(held), largest))
                    yield from sender.flush()
                    held, size = [], 0
            if held:
                yield from sender.add(_sorted_fold(np.concatenate(held), largest))
            yield from sender.flush()

        yield from _batched(blocks())

    return run


def _merge(step: int, rounds: int, largest: bool):
    """Merge the runs of each slot. Blocks come in the order of their first key, so all entries below the first key of
    the next block are complete; what is held back is at most the open block of each run."""

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, bool]]:
        slot, held = None, np.empty((0, _KEYS + 2), U64)
        waiting: list[np.ndarray] = []

        def cut(first: np.ndarray | None) -> np.ndarray:
            nonlocal held, waiting
            whole = _sorted_fold(np.concatenate([held, *waiting]), largest)
            waiting = []
            if first is None:
                held = whole[:0]
                return whole
            below = np.zeros(len(whole), bool)
            equal = np.ones(len(whole), bool)
            for k in range(4):
                below |= equal & (whole[:, k] < first[k])
                equal &= whole[:, k] == first[k]
            held = whole[~below]
            return whole[below]

        for batch in batches:
            for s, raw in zip(batch.column("slot").to_pylist(), batch.column("entries").to_pylist()):
                block = np.frombuffer(raw, U64).reshape(-1, _KEYS + 2)
                if s != slot:
                    if slot is not None:
                        yield slot, cut(None), True
                    slot = s
                elif len(waiting) >= FAN:
                    yield slot, cut(block[0]), False
                waiting.append(block)
        if slot is not None:
            yield slot, cut(None), True

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[int, np.ndarray]]:
            sender = None
            for slot, entries, over in settled(batches):
                sender = sender or _Sender(slot, step, rounds)
                yield from sender.add(entries)
                if over:
                    yield from sender.flush()
                    sender = None

        yield from _batched(blocks())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, entries, _ in settled(batches):
            if len(entries):
                raw = _word_bytes(entries).tobytes()
                numbers = np.ascontiguousarray(entries[:, 4:].T).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([raw[i:i + 32] for i in range(0, len(raw), 32)], pa.binary()), pa.array(numbers[0]),
                    pa.array(numbers[1]), pa.array(numbers[2], mask=numbers[2] == _NULL), pa.array(numbers[3])],
                    ["sha", "n_bytes", "check", "keep_id", "group_size"])

    return finish if step == rounds else send


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, sha (binary), n_bytes and check (second hash) of every row; null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"),
        F.octet_length(text).cast("bigint").alias("n_bytes"), F.xxhash64(text).alias("check"))


def merge_runs(digest_rows: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per distinct text: its key, the identifier that stays and the number of rows (sorted by slot and key)."""
    largest = keep == "largest"
    parts = digest_rows.rdd.getNumPartitions()
    rounds = 1
    while FAN ** rounds < parts:
        rounds += 1
    runs = digest_rows.mapInArrow(lean(_first_runs(rounds, largest)), _BLOCKS)
    for step in range(1, rounds + 1):
        exchanged = runs.repartitionById(FAN ** rounds, "slot").sortWithinPartitions("slot", "first")
        runs = exchanged.mapInArrow(lean(_merge(step, rounds, largest)), _MERGED if step == rounds else _BLOCKS)
    return runs


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """For every row its identifier, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (lower-case hex).

    Texts are equal when they are the same bytes. Of equal texts the smallest (``keep="largest"``: the largest)
    identifier stays. Null text counts as empty, and empty texts are equal to each other. A null identifier stays only
    if no row of its group has one (``keep_id`` is null then). Rows that repeat an identifier and a text all count in
    ``group_size`` and get the same answer. Other columns, whatever their names, are not read. Empty in, empty out.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep}")
    rows = cut_lineage(digests(docs, id_col, text_col))
    groups = merge_runs(rows, keep).where("group_size > 1")
    found = rows.join(groups, ["sha", "n_bytes", "check"], "left")
    grouped = F.col("group_size").isNotNull()
    keep_id = F.when(grouped, F.col("keep_id")).otherwise(F.col("id"))
    return found.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows that repeat both identifier and text leave one."""
    key, sha = free_name(docs.columns, "row_key"), free_name(docs.columns, "text_sha256")

    def no_null(column: str):  # null and the least long never meet in one text by more than a copy of it
        return F.coalesce(F.col(column).cast("bigint"), F.lit(_NULL))

    gone = exact_dedup(docs, id_col, text_col, keep).where("NOT kept").select(
        no_null(id_col).alias(key), F.col("text_sha256").alias(sha)).distinct()
    keyed = docs.withColumns({
        key: no_null(id_col), sha: F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)})
    return keyed.join(gone, [key, sha], "left_anti").dropDuplicates([key, sha]).select(*docs.columns)
