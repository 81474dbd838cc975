"""Ordered pieces put together: text chunks, tool-call deltas, WebSocket frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.config import SECRET_TYPES
from veilframe.functions.text import record_id
from veilframe.operators.ordered import SEGMENT_ROWS, lagged, numbered, running
from veilframe.session import cut_lineage

# --- fixed values -----------------------------------------------------------------------------------------------
TEXT_FRAME, CONTINUATION_FRAME = 1, 0
SKIP_AFTER = ("-c", "-e", "-lc", "--command", "--eval")
# ----------------------------------------------------------------------------------------------------------------


def reassemble(df: DataFrame, keys: list[str], seq: str, value: str, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Concatenate ``value`` in ``seq`` order per key: (keys, segment, text, n_chunks).

    A key of up to ``rows`` chunks gives one row with segment 0. A longer one gives one row per ``rows`` chunks, because
    neither a task nor a cell can take a stream of any length; concatenating the segments in order gives the whole.
    """
    placed = numbered(df.select(*keys, seq, value), keys, seq, "_row")
    pieces = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.coalesce(F.col(value), F.lit("")).alias("v"))))
    return (
        placed.withColumn("_segment", F.floor(F.col("_row") / rows))
        .groupBy(*keys, "_segment")
        .agg(F.array_join(F.transform(pieces, lambda p: p["v"]), "").alias("text"), F.count("*").alias("n_chunks"))
        .withColumnRenamed("_segment", "segment")
    )


_TYPES = "|".join(SECRET_TYPES)
BODY = rf"__VAULT_(?:{_TYPES})_[0-9a-f]{{8,9}}"
# A beginning of a token at the end of a text, with the tokens before it that share one or both underscores with it.
UNFINISHED = rf"(?:{BODY}_?)*(?:__VAULT_(?:{_TYPES})_[0-9a-f]{{0,9}}_?|__VAULT_[A-Z_]*|__VAULT|__VAUL|__VAU|__VA|__V|__|_)\z"


JOINED = 4096  # characters that short segments are joined up to
TOKEN_ROOM = 64  # no token, finished or not, is longer


def _regroup(segments: DataFrame, keys: list[str], head: Column) -> DataFrame:
    """Join each segment to the last one before it, or itself, that ``head`` marks."""
    marked = segments.withColumn("_mark", F.when(head, F.col("segment")))
    open_ = running(marked, keys, "segment", lasts={"_before": F.col("_mark")})
    placed = open_.withColumn("_to", F.coalesce("_mark", "_before", "segment"))
    rest = [c for c in segments.columns if c not in (*keys, "segment", "text")]
    pieces = F.sort_array(F.collect_list(F.struct("segment", "text")))
    return placed.groupBy(*keys, "_to").agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"),
        *[(F.sum(c) if c == "n_chunks" else F.min(c)).alias(c) for c in rest]).withColumnRenamed("_to", "segment").select(*segments.columns)


def token_safe(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Move the text of a token that is cut by segment borders into one segment, so that segments can be restored one by
    one. A run of tokens that share their underscores moves as a whole.

    Segments are first joined so that each has room for a token (by their place in the key's characters, then what is
    still short to the one before it), and a segment that is nothing but such a run is joined with the next. After that a
    token meets one border at most. Joined segments keep the number of their first part.
    """
    segments = cut_lineage(segments)
    sized = running(segments, keys, "segment", sums={"_at": F.length("text").cast("long")})
    first = lagged(sized.withColumn("_stretch", F.floor(F.col("_at") / JOINED)), keys, "segment", F.col("_stretch"), "_last")
    joined = _regroup(first.select(*segments.columns, "_stretch", "_last"), keys, F.col("_last").isNull() | (F.col("_last") != F.col("_stretch")))
    joined = cut_lineage(joined.select(*segments.columns))  # each step reads the one before it several times
    held = F.regexp_extract("text", UNFINISHED, 0)
    whole = lagged(joined, keys, "segment", (held != "") & (held == F.col("text")), "_run")
    head = F.col("_run").isNull() | ((F.length("text") >= TOKEN_ROOM) & ~F.col("_run"))
    joined = cut_lineage(_regroup(whole, keys, head).select(*segments.columns))
    last = running(joined.withColumn("_rev", -F.col("segment")), keys, "_rev",
                   sums={"_later": F.lit(1).cast("long")})
    cut = last.withColumn("_held", F.when(F.col("_later") > 0, held).otherwise(""))
    moved = lagged(cut, keys, "segment", F.col("_held"), "_carried")
    kept = F.left("text", F.length("text") - F.length("_held"))
    return moved.withColumn("text", F.concat(F.coalesce("_carried", F.lit("")), kept)).select(*segments.columns)


def tool_calls(deltas: DataFrame, stream: list[str], seq: str, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Assembled calls per (stream, index): first id, last non-empty name, joined arguments, place in the output."""
    keys = [*stream, "index"]
    at = F.col(seq)
    given = F.min_by(F.nullif("id", F.lit("")), at)
    heads = deltas.groupBy(*keys).agg(
        F.coalesce(given, F.concat(F.lit("call_"), record_id(F.concat_ws(":", *keys)))).alias("call_id"),
        F.coalesce(F.max_by("name", F.when(F.col("name") != "", at)), F.min_by("name", at), F.lit("tool")).alias("name"),
        F.min(seq).alias("first_seq"),
    )
    rank = Window.partitionBy(*stream).orderBy("first_seq", "index")
    heads = heads.withColumn("output_index", F.row_number().over(rank) - 1)
    bodies = reassemble(deltas, keys, seq, "arguments", rows).withColumnRenamed("text", "arguments")
    return heads.join(bodies, keys).select(
        *keys, "call_id", "name", "output_index", "segment", "arguments", "n_chunks")


def mark_text_frames(frames: DataFrame, conn: list[str], seq: str) -> DataFrame:
    """Add ``is_text`` and ``message``: a text frame opens a message, continuations belong to it until a final frame."""
    data = F.col("opcode").isin(TEXT_FRAME, CONTINUATION_FRAME)
    ends = running(frames, conn, seq, sums={"message": (data & F.col("fin")).cast("long")})
    opened = running(ends, conn, seq, lasts={"_opened": F.when(F.col("opcode") == TEXT_FRAME, F.col("message"))})
    inside = (F.col("opcode") == CONTINUATION_FRAME) & (F.col("_opened") == F.col("message"))
    is_text = (F.col("opcode") == TEXT_FRAME) | F.coalesce(inside, F.lit(False))
    return opened.withColumn("is_text", is_text).drop("_opened")


def frames_to_messages(frames: DataFrame, conn: list[str], seq: str, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Text messages of every connection; binary and control frames are not part of any."""
    text = mark_text_frames(frames, conn, seq).filter("is_text")
    return reassemble(text, [*conn, "message"], seq, "payload", rows)


def inspected_arguments(argv: DataFrame, command: list[str], pos: str, arg: str) -> DataFrame:
    """Mark arguments that hold program text for the previous option: they are passed on unread."""
    before = lagged(argv, command, pos, F.col(arg), "_before")
    return before.withColumn("inspected", ~F.coalesce(F.col("_before").isin(*SKIP_AFTER), F.lit(False))).drop("_before")


def system_runs(messages: DataFrame, thread: list[str], order: str, role: str, text: str,
                blocked: Column | None = None, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Merge neighbouring system messages of a thread, joined by a blank line; others stay one row each.

    ``blocked`` marks messages with tool fields, which are not extended. Result: (thread, first order, role, text,
    n_merged, part); a run longer than ``rows`` messages gives further rows, numbered by ``part``.
    """
    system = F.col(role) == "system"
    blocked = F.lit(False) if blocked is None else blocked
    state = lagged(messages.select(*thread, order, role, text, blocked.alias("_blocked")), thread, order,
                   F.struct(system.alias("sys"), F.col("_blocked").alias("blk")), "_prev")
    joins = system & F.coalesce(F.col("_prev")["sys"] & ~F.col("_prev")["blk"], F.lit(False))
    starts = state.withColumn("_start", F.when(~joins, F.col(order)))
    runs = running(starts, thread, order, lasts={"_open": F.col("_start")})
    run = runs.withColumn("first_order", F.coalesce("_start", "_open"))
    placed = numbered(run, [*thread, "first_order"], order, "_row").withColumn("part", F.floor(F.col("_row") / rows))
    pieces = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    texts = F.filter(F.transform(pieces, lambda p: F.coalesce(p["t"], F.lit(""))), lambda t: t != "")
    return placed.groupBy(*thread, "first_order", role, "part").agg(
        F.array_join(texts, "\n\n").alias("text"), F.count("*").alias("n_merged"))
