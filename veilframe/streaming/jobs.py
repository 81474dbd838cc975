"""Structured Streaming jobs over chunk streams, event lines and sessions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.config import DETECTION_WINDOW, DetectOptions
from veilframe.functions.http import route_provider
from veilframe.functions.rules import TOKEN_HEAD
from veilframe.functions.sse import json_text, sse_data, sse_text_fields
from veilframe.operators.findings import findings, skip_token_values
from veilframe.operators.mask import mask_as_of
from veilframe.operators.ordered import SEGMENT_ROWS
from veilframe.operators.restore import restore, restore_ansi
from veilframe.operators.vault import build_vault, sightings
from veilframe.session import shared_folder
from veilframe.streaming.cutters import Dictionary, TokenHold
from veilframe.streaming.events import Reshaped, Rewritten, Terminal
from veilframe.streaming.state import GROUPS, DealtStreams, Fields, Handler, OrderedStream, RollingWindow, RuleFollowing, Windows, packed, use_rocksdb

DICTIONARY_BYTES = 64 << 20  # what a worker takes into memory
INLINE_BYTES = 256 << 10  # what rides along with every task; larger lists are sent to each machine once, as a file


def dictionary(rules: DataFrame, limit: int = DICTIONARY_BYTES, inline: int = INLINE_BYTES) -> Dictionary:
    """The rules (source, target) as one dictionary for all workers, by measured size. A list too large for a worker is refused,
    never cut: text is then restored by join, or masked per session."""
    size = rules.agg(F.sum(F.octet_length("source") + F.octet_length("target") + 64).alias("bytes")).first()["bytes"] or 0
    if size > limit:
        raise ValueError("too many rules for an in-memory dictionary: restore by join, or mask per session")
    # Of rules that share a source the first target in text order counts.
    rules = rules.where("source <> ''").groupBy("source").agg(F.min("target").alias("target"))
    if size <= inline:
        return Dictionary([(r["source"], r["target"]) for r in rules.collect()])
    spark = rules.sparkSession
    folder = shared_folder(spark, "rules")
    rules.coalesce(1).write.json(folder)
    file = next(f for f in spark.read.text(folder).inputFiles())
    spark.sparkContext.addFile(file)
    return Dictionary(file=file.rsplit("/", 1)[1])


def _dictionary(spark: SparkSession, pairs: list[tuple[str, str]] | DataFrame) -> Dictionary:
    """Pairs given as a list are sent like a table once they are many."""
    if isinstance(pairs, DataFrame):
        return dictionary(pairs)
    if sum(len(s) + len(t) + 64 for s, t in pairs) <= INLINE_BYTES:
        return Dictionary(pairs)
    return dictionary(spark.createDataFrame(list(dict(pairs).items()), "source string, target string"))


def _fields(chunks: DataFrame, keys: list[str], fields: Column) -> DataFrame:
    return chunks.select(
        *keys, "seq", F.transform(fields, lambda f: f["key"]).alias("field_keys"),
        F.transform(fields, lambda f: f["value"]).alias("field_values"), "is_last")


def _run(chunks: DataFrame, keys: list[str], handler: Handler, shape: str, idle_ms: int | None = None, patience: int | None = None) -> DataFrame:
    """The streams of ``chunks`` through a handler; ``shape`` are the columns it gives besides the keys. Streams that do not expire
    are dealt to groups, whose state is read and written together."""
    use_rocksdb(chunks.sparkSession)
    schema = T.StructType([*[chunks.schema[k] for k in keys], *T._parse_datatype_string(shape).fields])
    rows = chunks.select(*keys, F.col("seq").cast("long").alias("seq"), "is_last", *handler.fields)
    if idle_ms is not None:
        return rows.groupBy(*keys).transformWithState(OrderedStream(schema.names, handler, idle_ms, patience), schema, "Append", "ProcessingTime")
    packs = _packs(rows, keys)
    return _unpacked(packs.groupBy("_group").transformWithState(DealtStreams(schema.names, keys, handler, patience), _lists(schema), "Append", "None"))


def _lists(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema])


def _packs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of streams dealt to groups by their keys, packed to rows of lists."""
    dealt = rows.select(F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).alias("_group"), "*")
    return dealt.mapInArrow(packed, T.StructType([dealt.schema["_group"], *_lists(rows.schema)]))


def _unpacked(packs: DataFrame) -> DataFrame:
    return packs.select(F.inline(F.arrays_zip(*packs.columns)))


PIECES = "seq long, field_key string, piece string, synthetic boolean"


def _single(chunks: DataFrame) -> Column:
    return F.array(F.struct(F.lit("").alias("key"), F.col("chunk").alias("value")))


def replace_stream(chunks: DataFrame, keys: list[str], pairs: list[tuple[str, str]] | DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Replace over chunk borders with one rule list, or table of (source, target): pieces whose concatenation is the replaced text."""
    return _run(_fields(chunks, keys, _single(chunks)), keys, Fields({None: _dictionary(chunks.sparkSession, pairs)}), PIECES, idle_ms)


def bidirectional_stream(
    chunks: DataFrame, keys: list[str], direction: str, pairs: list[tuple[str, str]], idle_ms: int | None = None,
) -> DataFrame:
    """Text going in is masked; output and API responses are restored. ``pairs`` are (secret, token)."""
    spark = chunks.sparkSession
    back = _dictionary(spark, [(t, s) for s, t in pairs])
    handler = Fields({"in": _dictionary(spark, pairs), "out": back, "api": back}, pick=keys.index(direction))
    return _run(_fields(chunks, keys, _single(chunks)), keys, handler, PIECES, idle_ms)


def rule_following_stream(chunks: DataFrame, changes: DataFrame, scope: list[str], stream: list[str], direction: str) -> DataFrame:
    """As ``bidirectional_stream``, with rules that follow the vault while the streams run.

    ``changes`` is a stream of vault changes (scope, secret, token, revision), which only reach the text of their scope;
    ``chunks`` has scope, stream, direction, seq, chunk, is_last. A change counts from the micro-batch on in which it
    arrives. Result: (scope, stream as one text, direction, seq, piece, synthetic).
    """
    use_rocksdb(chunks.sparkSession)
    none = F.lit(None)
    pieces = chunks.select(
        *scope, F.concat_ws(":", *stream).alias("stream"), F.col(direction).alias("direction"), F.col("seq").cast("long").alias("seq"), "is_last", "chunk",
        none.cast("string").alias("secret"), none.cast("string").alias("token"), none.cast("long").alias("revision"))
    rules = changes.where("secret <> ''").select(
        *scope, none.cast("string").alias("stream"), none.cast("string").alias("direction"), none.cast("long").alias("seq"), F.lit(False).alias("is_last"),
        none.cast("string").alias("chunk"), "secret", "token", F.col("revision").cast("long").alias("revision"))
    schema = T.StructType([*[pieces.schema[k] for k in scope], *T._parse_datatype_string(
        "stream string, direction string, seq long, piece string, synthetic boolean").fields])
    packs = _packs(pieces.unionByName(rules), scope)
    return _unpacked(packs.groupBy("_group").transformWithState(RuleFollowing(schema.names, scope), _lists(schema), "Append", "None"))


def token_pieces(chunks: DataFrame, keys: list[str], idle_ms: int | None = None) -> DataFrame:
    """Pieces in which no token is torn, for a restore by join with a vault of any size."""
    return _run(_fields(chunks, keys, _single(chunks)), keys, Fields({None: TokenHold()}), PIECES, idle_ms)


def sse_pieces(lines: DataFrame, keys: list[str], provider: str | Column, idle_ms: int | None = None) -> DataFrame:
    """The same per text field of server-sent events; what is left at the end comes as synthetic rows."""
    provider = F.lit(provider) if isinstance(provider, str) else provider
    fields = sse_text_fields(sse_data(F.col("line"))["json"], provider)
    return _run(_fields(lines, keys, fields), keys, Fields({None: TokenHold()}), PIECES, idle_ms)


REWRITTEN = "seq long, sub int, parts array<string>, pieces array<string>, synthetic boolean"


def sse_rewrite(lines: DataFrame, keys: list[str], provider: str, idle_ms: int | None = None) -> DataFrame:
    """Event lines of every stream, in order, their text fields cut where no token is torn (see ``Rewritten``); with the sink
    ``rewrite_to`` they are lines again, restored by join with a vault of any size."""
    return _run(lines.select(*keys, "seq", "line", "is_last"), keys, Rewritten(TokenHold(), provider), REWRITTEN, idle_ms)


def sse_replace(lines: DataFrame, keys: list[str], provider: str, pairs: list[tuple[str, str]], idle_ms: int | None = None) -> DataFrame:
    """Event lines with a bounded rule list replaced in their text fields, also over event borders: (keys, seq, sub, line, synthetic)."""
    cut = _run(lines.select(*keys, "seq", "line", "is_last"), keys, Rewritten(_dictionary(lines.sparkSession, pairs), provider), REWRITTEN, idle_ms)
    return cut.select(*keys, "seq", "sub", _line().alias("line"), "synthetic")


def _line() -> Column:
    """The pieces put back between the parts of their line."""
    pieces = F.transform("pieces", lambda p: json_text(p))
    return F.array_join(F.zip_with("parts", pieces, lambda part, piece: F.concat(part, F.coalesce(piece, F.lit("")))), "")


def rewrite_to(vault: DataFrame, keys: list[str], path: str) -> Callable[[DataFrame, int], None]:
    """Sink of ``sse_rewrite``: pieces are joined with the vault and put back between the parts of their line; one folder of
    (keys, seq, sub, line, synthetic) per micro-batch. In order of seq and sub the lines can be replayed. A line without a
    token's head is put together where it is; only the others are taken apart and shuffled."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        place = [*keys, "seq", "sub", "synthetic"]
        named = F.exists("pieces", lambda p: F.coalesce(F.contains(p, F.lit(TOKEN_HEAD)), F.lit(False)))
        cells = batch.where(named).select(*place, F.posexplode(F.arrays_zip("parts", "pieces")).alias("at", "c")).select(
            *place, "at", "c.parts", "c.pieces")
        whole = restore(cells, vault, [*place, "at"], "pieces", "restored")
        text = F.concat("parts", F.coalesce(json_text(F.col("restored")), F.lit("")))
        lines = whole.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("at", text.alias("t")))).alias("cells"))
        restored = lines.select(*place, F.array_join(F.transform("cells", lambda c: c["t"]), "").alias("line"))
        plain = batch.where(~F.coalesce(named, F.lit(False))).select(*place, _line().alias("line"))
        restored.unionByName(plain).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        batch.unpersist()

    return handle


EVENTS = ("phase int, seq long, sub long, part int, type string, output_index int, item_id string, text string, name string, "
          "call_id string, segment long, response string")


def response_event_stream(lines: DataFrame, keys: list[str], rows: int = SEGMENT_ROWS, model: str | None = None,
                          created_at: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """``response_events`` as a stream: the same rows, as soon as their line has come."""
    numbered = lines.select(*keys, "seq", "line", "is_last")
    return _run(numbered, keys, Reshaped(rows, model, created_at), EVENTS, idle_ms)


def ansi_pieces(chunks: DataFrame, keys: list[str], idle_ms: int | None = None) -> DataFrame:
    """Terminal output in pieces in which no visible token and no escape is torn, for ``restore_ansi_to``."""
    return _run(chunks.select(*keys, "seq", "chunk", "is_last"), keys, Terminal(),
                "seq long, sub int, piece string, raw boolean, synthetic boolean", idle_ms)


def restore_ansi_to(vault: DataFrame, keys: list[str], path: str) -> Callable[[DataFrame, int], None]:
    """Sink of ``ansi_pieces``: tokens of the visible text are restored by join, raw pieces stay."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        place = [*keys, "seq", "sub"]
        restored = restore_ansi(batch.where("NOT raw"), vault, place, "piece", "restored")
        out = restored.unionByName(batch.where("raw").withColumn("restored", F.col("piece")))
        out.select(*place, "restored", "synthetic").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        batch.unpersist()

    return handle


def exchange_stream(requests: DataFrame, responses: DataFrame, keys: list[str], lateness: str = "10 minutes", longest: str = "1 hour",
                    default_provider: str | None = None) -> DataFrame:
    """Requests and responses of an exchange correlated while both logs run: each response (keys, ts, headers, body) with the
    provider of its request (keys, ts, path, headers).

    Either log may be late by ``lateness``; a response comes within ``longest`` of its request. State older than both is
    dropped, so it is bounded by the traffic of that time.
    """
    asked = requests.withWatermark("ts", lateness).select(
        *[F.col(k).alias(f"_asked_{k}") for k in keys], F.col("ts").alias("asked_at"),
        route_provider(F.col("path"), F.col("headers"), default_provider)["provider"].alias("provider"))
    answered = responses.withWatermark("ts", lateness)
    match = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_asked_{k}") for k in keys])
    within = (F.col("ts") >= F.col("asked_at")) & (F.col("ts") <= F.col("asked_at") + F.expr(f"INTERVAL {longest}"))
    return answered.join(asked, match & within).select(*responses.columns, "provider")


def restore_exchanges_to(vault: DataFrame, keys: list[str], path: str) -> Callable[[DataFrame, int], None]:
    """Sink of ``exchange_stream``: every micro-batch is restored as ``restore_responses`` does in batch, in a folder of its own."""
    from veilframe.plans.pipelines import restore_responses

    def handle(batch: DataFrame, batch_id: int) -> None:
        restore_responses(batch, vault, keys).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return handle


def start_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def restore_to(vault: DataFrame, keys: list[str], path: str) -> Callable[[DataFrame, int], None]:
    """Sink of pieces: every micro-batch is joined with the vault and written to its own folder, so that a repeated
    batch replaces itself. The batch is held while it is joined, so that the stateful step before it runs once."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        restored = restore(batch, vault, [*keys, "seq", "field_key", "synthetic"], "piece", "restored")
        restored.drop("piece").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        batch.unpersist()

    return handle


def window_stream(turns: DataFrame, session: list[str], order: str, text: str, window: int = DETECTION_WINDOW) -> DataFrame:
    """Rolling detection text of every session as state."""
    use_rocksdb(turns.sparkSession)
    schema = T.StructType([*[turns.schema[k] for k in session], turns.schema[order], turns.schema[text],
                           T.StructField("window_text", T.StringType())])
    return turns.select(*session, order, text).groupBy(*session).transformWithStateInPandas(
        RollingWindow(session, order, text, window), schema, "Append", "None")


def ordered_window_stream(
    turns: DataFrame, session: list[str], order: str, text: str, patience: int = 1000, window: int = DETECTION_WINDOW, idle_ms: int | None = None,
) -> DataFrame:
    """The rolling detection text of every session, its turns (numbered from 0 in ``order``) in order over any number of
    micro-batches: (session, seq, text, window_text, late).

    A turn that is missing holds up to ``patience`` later ones back; then its place is given up, and if it still comes it is
    ``late``, without a window, for a side table (see ``apart``).
    """
    rows = turns.select(*session, F.col(order).cast("long").alias("seq"), F.col(text).alias("text"), F.lit(False).alias("is_last"))
    return _run(rows, session, Windows(window), "seq long, text string, window_text string, late boolean", idle_ms, patience)


def apart(path: str, late_path: str) -> Callable[[DataFrame, int], None]:
    """Sink that writes late rows beside the others, one folder per micro-batch in either place."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.where("NOT late").drop("late").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        batch.where("late").drop("late").write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")
        batch.unpersist()

    return handle


KNOWN = "secret string, token string, type string, first_order long"


def mask_sessions_to(
    spark: SparkSession, session: list[str], order: str, text: str, session_id: str, vault_path: str, out_path: str,
    options: DetectOptions = DetectOptions(),
) -> Callable[[DataFrame, int], None]:
    """Sink of windowed turns: register what is new, then mask each turn by what its session knows by then.

    The vault grows as one folder per micro-batch that holds the new secrets only. A repeated batch reads the folders
    before its own and overwrites its own.
    """

    def known_before(batch: DataFrame, batch_id: int) -> DataFrame:
        names = ", ".join(f"{batch.schema[s].name} {batch.schema[s].dataType.simpleString()}" for s in session)
        if batch_id == 0:
            return spark.createDataFrame([], f"{names}, {KNOWN}")
        stored = spark.read.schema(f"{names}, {KNOWN}, batch_id bigint").parquet(vault_path)
        return stored.filter(F.col("batch_id") < batch_id).drop("batch_id").join(
            batch.select(*session).distinct(), session, "left_semi")

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        old = known_before(batch, batch_id)
        found = skip_token_values(findings(batch, [*session, order], "window_text", options))
        fresh = found.join(old.select(*session, F.col("secret").alias("value")), [*session, "value"], "left_anti")
        fresh = fresh.withColumn("_seen", F.timestamp_seconds(F.col(order).cast("double"))).persist()
        events = sightings(fresh, "stdin", F.col("_seen"), [order, "start"], scope=session)
        # The stored entries of these sessions take part, so that no new secret gets a token that one of them holds.
        place = events.schema["ord"].dataType.simpleString()
        events = events.withColumn("token", F.lit(None).cast("string")).withColumn("hit_count", F.lit(None).cast("long"))
        before = old.select(*session, "secret", "type", F.lit("stdin").alias("source"), F.lit(None).cast("timestamp").alias("seen_at"),
                            F.lit(None).cast("string").alias("name"), F.lit(None).cast(place).alias("ord"), "token",
                            F.lit(None).cast("long").alias("hit_count"))
        both = events.withColumn("ord", F.struct(F.lit(1).alias("phase"), "ord")).unionByName(
            before.withColumn("ord", F.struct(F.lit(0).alias("phase"), "ord")))
        vault = build_vault(both, session_id, scope=session)
        first = fresh.groupBy(*session, F.col("value").alias("secret")).agg(F.min(order).cast("long").alias("first_order"))
        grown = vault.join(first, [*session, "secret"]).select(*session, "secret", "token", "type", "first_order")
        grown.write.mode("overwrite").parquet(f"{vault_path}/batch_id={batch_id}")
        known = old.unionByName(spark.read.schema(grown.schema).parquet(f"{vault_path}/batch_id={batch_id}"))
        masked = mask_as_of(batch, known, session, [*session, order], order, "first_order", text, "masked_text")
        masked.drop("window_text").write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        fresh.unpersist()
        batch.unpersist()

    return handle


def ledger_stream(events: DataFrame) -> DataFrame:
    """The audit ledger as a streaming aggregate (update mode): one row per secret that changed in the batch."""
    from veilframe.operators.audit import audit_ledger

    return audit_ledger(events)
