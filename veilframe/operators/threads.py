"""Response threads: every response names the one it continues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.chat import (
    MESSAGE, input_messages, instruction_messages, merge_system_runs, to_chat_request, to_response,
)
from veilframe.functions.spans import let
from veilframe.operators.ordered import SEGMENT_ROWS, running
from veilframe.session import cut_lineage


def ancestor_jumps(responses: DataFrame, id_: str, previous: str) -> list[DataFrame]:
    """Pointer tables: table k gives the ancestor 2**k steps up. As many tables as the deepest thread has binary digits;
    a previous id that is not stored ends the thread."""
    known = responses.select(F.col(id_).alias("_known")).distinct()
    jump = responses.select(F.col(id_).alias("node"), F.col(previous).alias("up")).filter("up is not null")
    jump = cut_lineage(jump.join(known, F.col("up") == F.col("_known"), "left_semi"))
    jumps = []
    while not jump.isEmpty():
        if len(jumps) > 62:
            raise ValueError("response chain has a cycle")
        jumps.append(jump)
        nxt = jump.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        jump = cut_lineage(jump.join(nxt, "up").select("node", F.col("up2").alias("up")))
    return jumps


def thread_index(responses: DataFrame, id_: str, previous: str) -> DataFrame:
    """Root and depth of every response, in as many joins as the depth has binary digits."""
    at = responses.select(F.col(id_), F.col(id_).alias("root"), F.lit(0).cast("long").alias("depth"))
    for k, jump in reversed(list(enumerate(ancestor_jumps(responses, id_, previous)))):
        step = jump.withColumnRenamed("node", "root")
        at = at.join(step, "root", "left").select(
            id_, F.coalesce("up", "root").alias("root"),
            (F.col("depth") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("depth"))
    return at


def thread_history(responses: DataFrame, id_: str, previous: str, columns: list[str],
                   leaves_only: bool = True) -> DataFrame:
    """Stored rows that a response's history is made of, oldest first by ``position``.

    By default for responses nothing continues: a message then appears once per thread it belongs to, not once per
    later response. All responses are served on request; that result is as large as the histories are.
    """
    targets = responses.select(F.col(id_).alias("response_id"))
    if leaves_only:
        continued = responses.select(F.col(previous).alias("response_id")).filter("response_id is not null").distinct()
        targets = targets.join(continued, "response_id", "left_anti")
    lines = targets.withColumn("node", F.col("response_id")).withColumn("distance", F.lit(0).cast("long"))
    for k, jump in reversed(list(enumerate(ancestor_jumps(responses, id_, previous)))):
        above = lines.join(jump, "node").select(
            "response_id", F.col("up").alias("node"), (F.col("distance") + (1 << k)).alias("distance"))
        lines = cut_lineage(lines.unionByName(above))
    depth = lines.groupBy("response_id").agg(F.max("distance").alias("depth"))
    stored = responses.select(F.col(id_).alias("node"), *columns)
    return lines.join(depth, "response_id").join(stored, "node").select(
        "response_id", (F.col("depth") - F.col("distance")).alias("position"), F.col("node").alias("from_response"),
        *columns)


def resolve_versions(log: DataFrame, id_: str, previous: str, order: str) -> DataFrame:
    """Every row of the log as a version of its response id: adds ``node`` (that version) and ``parent``, the latest version of the
    response it names that was stored before it, or null where there is none.

    ``order`` is an integer, unique in the log. An id that is stored again is replaced for what comes later; what continued the
    earlier version keeps it. One pass over ids in order, however often an id is stored or named.
    """
    node = F.concat_ws(":", F.col(id_), F.col(order).cast("string"))
    versions = log.where(F.col(id_).isNotNull()).select(
        F.col(id_).alias("_id"), (F.col(order) * 2 + 1).alias("_at"), node.alias("_node"), F.lit(None).cast("long").alias("_asked"))
    asked = log.where(F.col(previous).isNotNull()).select(
        F.col(previous).alias("_id"), (F.col(order) * 2).alias("_at"), F.lit(None).cast("string").alias("_node"), F.col(order).cast("long").alias("_asked"))
    found = running(versions.unionByName(asked), ["_id"], "_at", lasts={"parent": F.col("_node")})
    parents = found.where("_asked IS NOT NULL AND parent IS NOT NULL").select("_asked", "parent")
    return log.withColumn("node", node).join(parents, F.col(order) == F.col("_asked"), "left").drop("_asked")


def stored_history(log: DataFrame, id_: str, previous: str, order: str, request: str, response: str,
                   leaves_only: bool = True, rows: int = SEGMENT_ROWS) -> DataFrame:
    """The messages that each request's history holds: (node, segment, n_segments, messages), in order of segment.

    A stored response adds the messages of its request (with the instructions, where it has no history itself) and the
    assistant's message. A history of more than ``rows`` responses comes in several segments, since no cell takes a thread of
    any length; requests without a history have no row. By default for requests that nothing continues.
    """
    none = F.array().cast(f"array<{MESSAGE}>")

    def said(payload):
        return F.concat(F.when(F.col("parent").isNull(), instruction_messages(payload)).otherwise(none), input_messages(payload))

    fresh = F.coalesce(let(F.try_parse_json(F.col(request)), said), none)
    reply = to_response(F.col(response), F.col(id_))["stored_message"]
    added = F.when(F.col(response).isNotNull(), F.concat(fresh, F.array(reply.cast(MESSAGE)))).otherwise(fresh)
    nodes = cut_lineage(resolve_versions(log, id_, previous, order).select("node", "parent", added.alias("added")))
    lines = thread_history(nodes, "node", "parent", ["added"], leaves_only).where(F.col("response_id") != F.col("from_response"))
    pieces = F.array_sort(F.collect_list(F.struct("position", "added")))
    segments = lines.withColumn("segment", F.floor(F.col("position") / rows)).groupBy(F.col("response_id").alias("node"), "segment").agg(
        merge_system_runs(F.flatten(F.transform(pieces, lambda p: p["added"]))).alias("messages"))
    count = lines.groupBy(F.col("response_id").alias("node")).agg((F.floor(F.max("position") / rows) + 1).alias("n_segments"))
    return segments.join(count, "node").select("node", "segment", "n_segments", "messages")


def chat_requests_with_history(log: DataFrame, id_: str, previous: str, order: str, request: str, response: str,
                               leaves_only: bool = True, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Logged requests as chat requests with their history in front: (id, order, n_segments, chat).

    A request is what ``to_chat_request`` gives. Where the history lies in several segments ``chat`` is null: its messages are
    those of ``stored_history``, segment by segment.
    """
    log = cut_lineage(log.select(id_, previous, order, request, response))
    history = stored_history(log, id_, previous, order, request, response, leaves_only, rows)
    asked = log.withColumn("node", F.concat_ws(":", F.col(id_), F.col(order).cast("string")))
    if leaves_only:
        continued = resolve_versions(log, id_, previous, order).where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
        asked = asked.join(continued, "node", "left_anti")
    joined = asked.join(history.where("segment = 0"), "node", "left")
    segments = F.coalesce("n_segments", F.lit(0)).cast("long")
    return joined.select(id_, order, segments.alias("n_segments"), F.when(segments < 2, to_chat_request(F.col(request), F.col("messages"))).alias("chat"))
