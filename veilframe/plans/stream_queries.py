"""Queries that run as Structured Streaming jobs over the given tables and read their sinks back."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.config import DetectOptions
from veilframe.functions.sse import sse_data, sse_text_fields
from veilframe.functions.text import vault_token
from veilframe.operators.chunks import reassemble
from veilframe.plans.pipelines import restore_traffic
from veilframe.plans.registry import SESSION, Injected, query, table, utc
from veilframe.plans.traffic_queries import _PLANTED_TURN, _C, _said, _tokenised, sql_token
from veilframe.session import cut_lineage, shared_folder, spread
from veilframe.sources.vault_store import read_vault
from veilframe.streaming import jobs
from veilframe.streaming.sealed import sealed_sessions, sealed_to

PIECE = 11
_TURN_SECRET = Injected("ghp_{k:36}", "conv_id")


def replayed(spark, df, place):
    """``df`` as a stream of three micro-batches: first the rows whose ``place`` is 0, then 1, then 2. Each place has the same number of
    files, if need be empty ones, so that no micro-batch takes files of two places."""
    folder, df = shared_folder(spark, "replay"), cut_lineage(df)
    files = df.rdd.getNumPartitions()
    for i in range(3):
        part = f"{folder}/part={i}"
        df.where(place == i).write.parquet(part)
        for _ in range(files - len(spark.read.schema(df.schema).parquet(part).inputFiles())):
            df.limit(0).write.mode("append").parquet(part)
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(folder)


def mixed(*columns):
    """A place that deals rows out by hash, so that they arrive out of order."""
    return F.pmod(F.hash(*columns), F.lit(3))


def _chunked(texts, keys, text):
    """Texts as chunk streams: pieces with a number each and a mark on the last."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[\s\S]{{1,{PIECE}}}"), F.lit(0))
    return texts.select(*keys, pieces.alias("pieces")).select(
        *keys, F.size("pieces").alias("n"), F.posexplode("pieces").alias("seq", "chunk")).select(
        *keys, F.col("seq").cast("long").alias("seq"), "chunk", (F.col("seq") == F.col("n") - 1).alias("is_last"))


def _pieces(spark, sf_dir: str, text):
    return _chunked(spread(table(spark, sf_dir, "conversations")), ["conv_id", "turn"], text)


def stream_chunks(spark, sf_dir: str, text):
    return replayed(spark, _pieces(spark, sf_dir, text), mixed("conv_id", "turn", "seq"))


def _tokenised_text():
    token = vault_token(Injected("ghp_{k:36}", "conv_id").spark, F.lit("APIKEY"), F.lit(SESSION))
    return F.concat("text", F.lit(" key "), token, F.lit(", again "), token, F.lit("."))


def _joined(pieces):
    """Pieces of a stream put back together, the synthetic rest last."""
    placed = pieces.withColumn("place", F.col("seq") * 2 + F.col("synthetic").cast("long"))
    return reassemble(placed, ["conv_id", "turn"], "place", "restored").select("conv_id", "turn", "segment", "text")


@query("stream_replace_chunks", """
    SELECT conv_id, turn, 0::BIGINT AS segment, replace(replace(text, 'la ', 'LA_'), 'th', '<t>') AS text FROM conversations WHERE length(text) > 0""")
def stream_replace_chunks(spark, sf):
    chunks = stream_chunks(spark, sf, F.col("text"))
    replaced = jobs.replace_stream(chunks, ["conv_id", "turn"], [("la ", "LA_"), ("th", "<t>")])
    out = shared_folder(spark, "replaced")
    replaced.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_folder(spark, "ckpt")).trigger(
        availableNow=True).start().awaitTermination()
    return _joined(spark.read.schema(replaced.schema).parquet(out).withColumnRenamed("piece", "restored"))


@query("stream_bidirectional", f"""
    SELECT conv_id, turn, 0::BIGINT AS segment, CASE WHEN role = 'user' THEN replace(text, 'the', '__VAULT_GENERIC_00000001__') ELSE text || 'the.' END AS text
    FROM conversations WHERE length(text) > 0""")
def stream_bidirectional(spark, sf):
    """User turns are masked, all others carry a token at their end that is restored."""
    token = "__VAULT_GENERIC_00000001__"
    base = spread(table(spark, sf, "conversations"))
    text = F.when(F.col("role") == "user", F.col("text")).otherwise(F.concat("text", F.lit(token + ".")))
    pieces = F.regexp_extract_all(text, F.lit(rf"[\s\S]{{1,{PIECE}}}"), F.lit(0))
    direction = F.when(F.col("role") == "user", "in").when(F.col("role") == "assistant", "out").otherwise("api")
    chunks = base.filter("length(text) > 0").select("conv_id", "turn", direction.alias("direction"), pieces.alias("p")).select(
        "conv_id", "turn", "direction", F.size("p").alias("n"), F.posexplode("p").alias("seq", "chunk")).select(
        "conv_id", "turn", "direction", F.col("seq").cast("long").alias("seq"), "chunk", (F.col("seq") == F.col("n") - 1).alias("is_last"))
    chunks = replayed(spark, chunks, mixed("conv_id", "turn", "seq"))
    moved = jobs.bidirectional_stream(chunks, ["conv_id", "turn", "direction"], "direction", [("the", token)])
    out = shared_folder(spark, "moved")
    moved.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_folder(spark, "ckpt")).trigger(
        availableNow=True).start().awaitTermination()
    return _joined(spark.read.schema(moved.schema).parquet(out).withColumnRenamed("piece", "restored"))


@query("stream_restore_chunks", f"SELECT conv_id, turn, 0::BIGINT AS segment, {_PLANTED_TURN.sql} AS text FROM conversations")
def stream_restore_chunks(spark, sf):
    """Tokens torn by chunk borders are held back whole and restored by join with the vault."""
    _, vault = _tokenised(spark, sf)
    pieces = jobs.token_pieces(stream_chunks(spark, sf, _tokenised_text()), ["conv_id", "turn"])
    out = shared_folder(spark, "restored")
    jobs.start_batches(pieces, jobs.restore_to(vault, ["conv_id", "turn"], out), shared_folder(spark, "ckpt")).awaitTermination()
    return _joined(spark.read.parquet(out))


@query("stream_restore_events", f"""
    SELECT conv_id, turn, 0::BIGINT AS segment, 'openai:0:delta.content' AS field_key, {_PLANTED_TURN.sql} AS text FROM conversations""")
def stream_restore_events(spark, sf):
    """The same inside the text fields of server-sent events."""
    _, vault = _tokenised(spark, sf)
    payload = F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"), F.struct(
        F.col("chunk").alias("content")).alias("delta"))).alias("choices")))
    lines = stream_chunks(spark, sf, _tokenised_text()).withColumn("line", F.concat(F.lit("data: "), payload))
    out = shared_folder(spark, "events")
    jobs.start_batches(jobs.sse_pieces(lines, ["conv_id", "turn"], "openai"),
                       jobs.restore_to(vault, ["conv_id", "turn"], out), shared_folder(spark, "ckpt")).awaitTermination()
    placed = spark.read.parquet(out).withColumn("place", F.col("seq") * 2 + F.col("synthetic").cast("long"))
    return reassemble(placed, ["conv_id", "turn", "field_key"], "place", "restored").select(
        "conv_id", "turn", "segment", "field_key", "text")


def _collected(stream, sink, out):
    jobs.start_batches(stream, sink, shared_folder(stream.sparkSession, "ckpt")).awaitTermination()
    return stream.sparkSession.read.parquet(out)


@query("stream_sse_rewrite", f"""
    SELECT conv_id, turn, 'openai:0:delta.content' AS field_key, {_PLANTED_TURN.sql} AS text, ceil((length(text) + 64) / {PIECE}.0)::BIGINT AS n_events,
      'data: [DONE]' AS last_line FROM conversations""")
def stream_sse_rewrite(spark, sf):
    """Event lines restored and written back as lines: read again, their text is that of the batch restore."""
    _, vault = _tokenised(spark, sf)
    event = F.to_json(F.struct(F.lit("m").alias("model"), F.array(F.struct(F.lit(0).alias("index"), F.struct(
        F.col("chunk").alias("content")).alias("delta"))).alias("choices")))
    chunks = _pieces(spark, sf, _tokenised_text())
    lines = chunks.select("conv_id", "turn", "seq", F.concat(F.lit("data: "), event).alias("line"), F.lit(False).alias("is_last")).unionByName(
        chunks.where("is_last").select("conv_id", "turn", F.col("seq") + 1, F.lit("data: [DONE]"), F.lit(True)).toDF("conv_id", "turn", "seq", "line", "is_last"))
    lines = replayed(spark, lines, mixed("conv_id", "turn", "seq"))
    out, keys = shared_folder(spark, "lines"), ["conv_id", "turn"]
    written = _collected(jobs.sse_rewrite(lines, keys, "openai"), jobs.rewrite_to(vault, keys, out), out)
    # Numbering reads the fields twice: they are written once, not taken from the lines twice. A few MB of lines are work for all cores.
    fields = cut_lineage(spread(written.select(*keys, "seq", "sub", "line"), *keys, "seq").select(*keys, (F.col("seq") * 1000 + F.col("sub")).alias("place"), F.explode(
        sse_text_fields(sse_data(F.col("line"))["json"], F.lit("openai"))).alias("f")).select(*keys, "place", "f.*"))
    texts = reassemble(fields, [*keys, "key"], "place", "value", rows=1 << 20).select(*keys, F.col("key").alias("field_key"), "text")
    own = written.where("NOT synthetic").groupBy(*keys).agg(
        (F.count("*") - 1).alias("n_events"), F.max_by("line", "seq").alias("last_line"))
    return texts.join(own, keys).select(*keys, "field_key", "text", "n_events", "last_line")


@query("stream_response_events", f"""
    SELECT conv_id, turn, type, CAST(n AS BIGINT) AS n_events, CASE WHEN type = 'response.output_text.done' THEN text END AS text,
      CASE WHEN type = 'response.completed' THEN text WHEN type = 'response.created' THEN '' END AS output_text,
      CASE WHEN type = 'response.completed' THEN 'completed' WHEN type = 'response.created' THEN 'in_progress' END AS status,
      CASE WHEN type = 'response.completed' THEN '{{"q":' || turn || '}}' END AS call_arguments FROM conversations,
    LATERAL (VALUES ('response.created', 1), ('response.output_item.added', 2), ('response.content_part.added', 1),
      ('response.output_text.delta', CAST(ceil(length(text) / {PIECE}.0) AS INTEGER)), ('response.output_text.done', 1), ('response.content_part.done', 1),
      ('response.function_call_arguments.delta', 2), ('response.function_call_arguments.done', 1), ('response.output_item.done', 2),
      ('response.completed', 1)) AS v(type, n)""")
def stream_response_events(spark, sf):
    """Chat deltas with a text and a tool call, re-shaped as they come, over three micro-batches out of order."""
    pieces = _pieces(spark, sf, F.col("text"))

    def line(delta, finish=None):
        return F.concat(F.lit('data: {"choices":[{"index":0,"delta":'), delta, F.lit("" if finish is None else f',"finish_reason":"{finish}"'), F.lit("}]}"))

    def call(fields, arguments):
        return F.concat(F.lit('{"tool_calls":[{"index":0,' + fields), arguments, F.lit("}}]}"))

    content = pieces.select("conv_id", "turn", "seq", line(F.to_json(F.struct(F.col("chunk").alias("content")))).alias("line"), F.lit(False).alias("is_last"))
    ends = pieces.where("is_last")
    opened = line(call('"id":"c1","function":{"name":"look","arguments":', F.lit('"{\\"q\\":"')))
    closed = line(call('"function":{"arguments":', F.concat(F.lit('"'), F.col("turn").cast("string"), F.lit('}"'))), "tool_calls")
    rest = [ends.select("conv_id", "turn", (F.col("seq") + i).alias("seq"), text.alias("line"), F.lit(last).alias("is_last"))
            for i, text, last in ((1, opened, False), (2, closed, False), (3, F.lit("data: [DONE]"), True))]
    lines = content.unionByName(rest[0]).unionByName(rest[1]).unionByName(rest[2])
    events = jobs.response_event_stream(replayed(spark, lines, mixed("conv_id", "turn", "seq")), ["conv_id", "turn"], model="m")
    out = shared_folder(spark, "events")
    events.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_folder(spark, "ckpt")).trigger(
        availableNow=True).start().awaitTermination()
    get = F.get_json_object
    return spark.read.schema(events.schema).parquet(out).groupBy("conv_id", "turn", "type").agg(
        F.count("*").alias("n_events"), F.max(F.when(F.col("type") == "response.output_text.done", F.col("text"))).alias("text"),
        F.max(get("response", "$.output_text")).alias("output_text"), F.max(get("response", "$.status")).alias("status"),
        F.max(get("response", "$.output[1].arguments")).alias("call_arguments"))


_USER_SECRET = Injected("pw-{k:12}", "conv_id")


@query("stream_rules_follow", f"""
    SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS stream, CASE WHEN turn >= 1 THEN replace(t, s, tok) || t ELSE t || t END AS text FROM (
      SELECT conv_id, turn, 'say ' || {_USER_SECRET.sql} || '. ' || text AS t, {_USER_SECRET.sql} AS s,
             '__VAULT_PASSWORD_' || substr(sha256({_USER_SECRET.sql}), 1, 8) || '__' AS tok FROM conversations)""")
def stream_rules_follow(spark, sf):
    """The vault learns each conversation's secret in the second micro-batch: text of the first goes out as it is, later text is
    masked, and tokens that come back are restored."""
    secret = _USER_SECRET.spark
    token = F.concat(F.lit("__VAULT_PASSWORD_"), F.substring(F.sha2(secret, 256), 1, 8), F.lit("__"))
    said = spread(table(spark, sf, "conversations")).select(
        F.col("conv_id").cast("string").alias("conv_id"), "turn", F.concat(F.lit("say "), secret, F.lit(". "), F.col("text")).alias("t"),
        F.when(F.col("turn") >= 1, token).otherwise(secret).alias("back"), secret.alias("secret"))
    answer = F.concat(F.lit("say "), F.col("back"), F.substring("t", F.length("secret") + 5, F.length("t")))
    both = said.select("conv_id", "turn", F.explode(F.array(
        F.struct(F.lit("in").alias("direction"), F.col("t").alias("text")), F.struct(F.lit("out").alias("direction"), answer.alias("text")))).alias("x"))
    chunks = _chunked(both.select("conv_id", "turn", "x.direction", "x.text"), ["conv_id", "turn", "direction"], F.col("text"))
    changes = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("conv_id"), secret.alias("secret"), token.alias("token")).distinct()
    changes = changes.select("conv_id", F.explode(F.array(
        F.struct(F.lit(0).alias("place"), F.lit("never-said-1").alias("secret"), F.lit("__VAULT_GENERIC_0000000a__").alias("token")),
        F.struct(F.lit(1).alias("place"), F.col("secret"), F.col("token")),
        F.struct(F.lit(2).alias("place"), F.lit("never-said-2").alias("secret"), F.lit("__VAULT_GENERIC_0000000b__").alias("token")))).alias("c")).select(
        "conv_id", "c.secret", "c.token", F.col("c.place").alias("revision"))
    moved = jobs.rule_following_stream(
        replayed(spark, chunks, F.least(F.col("turn"), F.lit(2))), replayed(spark, changes, F.col("revision")), ["conv_id"], ["turn"], "direction")
    out = shared_folder(spark, "followed")
    moved.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_folder(spark, "ckpt")).trigger(
        availableNow=True).start().awaitTermination()
    pieces = spark.read.schema(moved.schema).parquet(out).withColumn(
        "place", (F.col("direction") == "out").cast("long") * (1 << 40) + F.col("seq") * 2 + F.col("synthetic").cast("long"))
    return reassemble(pieces, ["conv_id", "stream"], "place", "piece", rows=1 << 20).select("conv_id", "stream", "text")


@query("stream_restore_ansi", f"""
    SELECT conv_id, turn, text || chr(27) || '[1mkey ' || {_TURN_SECRET.sql} || chr(27) || '[0m.' AS text FROM conversations""")
def stream_restore_ansi(spark, sf):
    """Terminal output in chunks that tear tokens and escapes, with escapes inside the tokens."""
    _, vault = _tokenised(spark, sf)
    token = vault_token(_TURN_SECRET.spark, F.lit("APIKEY"), F.lit(SESSION))
    torn = F.concat(F.left(token, F.lit(12)), F.lit("\x1b[31m"), F.substring(token, 13, 100))
    chunks = stream_chunks(spark, sf, F.concat("text", F.lit("\x1b[1mkey "), torn, F.lit("\x1b[0m.")))
    out, keys = shared_folder(spark, "terminal"), ["conv_id", "turn"]
    restored = _collected(jobs.ansi_pieces(chunks, keys), jobs.restore_ansi_to(vault, keys, out), out)
    placed = restored.withColumn("place", F.col("seq") * 4 + F.col("sub"))
    return reassemble(placed, keys, "place", "restored", rows=1 << 20).select(*keys, "text")


@query("stream_ordered_windows", """
    SELECT conv_id, turn, right(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 4096) AS window_text
    FROM conversations""")
def stream_ordered_windows(spark, sf):
    """Turns dealt over three micro-batches at random: the windows are those of the turns in order, and none is late."""
    turns = replayed(spark, table(spark, sf, "conversations").select("conv_id", "turn", "text"), mixed("conv_id", "turn"))
    windows = jobs.ordered_window_stream(turns, ["conv_id"], "turn", "text")
    out, late = shared_folder(spark, "windows"), shared_folder(spark, "late")
    found = _collected(windows, jobs.apart(out, late), out)
    return found.select("conv_id", F.col("seq").alias("turn"), "window_text").unionByName(
        spark.read.parquet(late).select("conv_id", F.col("seq").alias("turn"), F.lit("late").alias("window_text")))


@query("stream_session_mask", f"""
    SELECT conv_id, turn, CASE WHEN turn >= 1 THEN replace(t, c, {sql_token('c', "'PASSWORD'")}) ELSE t END AS masked_text
    FROM (SELECT conv_id, turn, {_said(False)} AS t, {_C} AS c FROM conversations)""")
def stream_session_mask(spark, sf):
    """Rolling detection as state, registration and masking per micro-batch."""
    said = table(spark, sf, "conversations").select("conv_id", "turn", F.expr(_said(True)).alias("text"))
    said = replayed(spark, said, F.least(F.col("turn"), F.lit(2)))  # turns come in order, sessions over several batches
    windows = jobs.window_stream(said, ["conv_id"], "turn", "text")
    vault, out = shared_folder(spark, "vault"), shared_folder(spark, "masked")
    sink = jobs.mask_sessions_to(spark, ["conv_id"], "turn", "text", SESSION, vault, out, DetectOptions(patterns=False, entropy=False))
    jobs.start_batches(windows, sink, shared_folder(spark, "ckpt")).awaitTermination()
    return spark.read.parquet(out).select("conv_id", "turn", "masked_text")


@query("stream_sealed_sessions", f"""
    WITH s AS (SELECT conv_id, turn, {_said(False)} AS t, {_C} AS c FROM conversations)
    SELECT conv_id, turn, CASE WHEN turn >= 1 THEN replace(t, c, {sql_token('c', "'PASSWORD'")}) ELSE t END AS masked_text, false AS late,
      CASE WHEN turn = (SELECT min(turn) FROM s r WHERE r.conv_id = s.conv_id AND r.turn >= 1) THEN c END AS secret FROM s""")
def stream_sealed_sessions(spark, sf):
    """Sessions over micro-batches that deal turns at random: the vault is sealed keyed state, what it registers is read back from
    the encrypted vault."""
    said = table(spark, sf, "conversations").select("conv_id", "turn", F.expr(_said(True)).alias("text"))
    turns = sealed_sessions(replayed(spark, said, mixed("conv_id", "turn")), ["conv_id"], "turn", "text", SESSION, "pass phrase",
                            options=DetectOptions(patterns=False, entropy=False))
    out, vault = shared_folder(spark, "masked"), shared_folder(spark, "vault")
    masked = _collected(turns, sealed_to(["conv_id"], out, vault, "pass phrase"), out)
    stored = read_vault(spark, vault, "pass phrase").select("token", "secret").distinct()
    first = masked.select("conv_id", F.col("seq").alias("turn"), "masked_text", "late")
    named = first.where("turn >= 1").groupBy("conv_id").agg(F.min("turn").alias("turn"), F.max(
        F.regexp_extract("masked_text", "__VAULT_PASSWORD_[0-9a-f]{8,9}__", 0)).alias("token")).join(stored, "token").select("conv_id", "turn", "secret")
    return first.join(named, ["conv_id", "turn"], "left").select("conv_id", "turn", "masked_text", "late", "secret")


@query("stream_audit", """
    SELECT substr(sha256(event_type), 1, 12) AS id, epoch_us(min(ts)) AS created_us, epoch_us(max(ts)) AS last_seen_us, count(*) AS seen_count
    FROM events GROUP BY event_type""")
def stream_audit(spark, sf):
    """Ledger as a streaming aggregate; the last state of every record is read back."""
    seen = utc(F.col("ts"))
    events = replayed(spark, table(spark, sf, "events"), mixed("event_id")).select(
        F.col("event_type").alias("secret"), F.lit("GENERIC").alias("type"), F.lit("stdin").alias("source"), seen.alias("seen_at"),
        F.lit(None).cast("string").alias("name"), F.struct("ts", "event_id").alias("ord"))
    out = shared_folder(spark, "ledger")

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    jobs.ledger_stream(events).writeStream.outputMode("update").foreachBatch(sink).option(
        "checkpointLocation", shared_folder(spark, "ckpt")).trigger(availableNow=True).start().awaitTermination()
    states = spark.read.parquet(out).groupBy("id").agg(F.max_by(F.struct("created_at", "last_seen_at", "seen_count"), "batch_id").alias("r"))
    ledger = states.select("id", "r.*")
    return ledger.select("id", F.unix_micros("created_at").alias("created_us"),
                                 F.unix_micros("last_seen_at").alias("last_seen_us"), "seen_count")


_KIND = "CASE WHEN turn % 3 = 0 THEN 'events' WHEN turn % 3 = 1 THEN 'text' ELSE 'other' END"


def _exchanges(spark, sf):
    """Every turn as an exchange: by turn an event stream, a text, or a body that is neither."""
    _, vault = _tokenised(spark, sf)
    said = table(spark, sf, "conversations").select("conv_id", "turn", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 10).alias("ts"), _tokenised_text().alias("text"))
    requests = said.select("conv_id", "turn", "ts", F.lit("/v1/chat/completions").alias("path"), F.create_map().cast("map<string,array<string>>").alias("headers"))
    event = F.transform(F.regexp_extract_all("text", F.lit(rf"[\s\S]{{1,{PIECE}}}"), F.lit(0)), lambda piece: F.concat(
        F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(piece.alias("content")).alias("delta"))).alias("choices")))))
    events = F.concat(F.array_join(event, "\r\n\r\n"), F.lit("\r\n\r\ndata: [DONE]\r\n"))
    kind = F.expr(_KIND)
    type_ = F.when(kind == "events", "text/event-stream; charset=utf-8").when(kind == "text", "application/json").otherwise("image/png")
    responses = said.select("conv_id", "turn", (F.col("ts") + F.expr("INTERVAL 2 seconds")).alias("ts"),
                            F.create_map(F.lit("Content-Type"), F.array(type_)).alias("headers"), F.when(kind == "events", events).otherwise(F.col("text")).alias("body"))
    return requests, responses, vault


def _read_back(restored):
    """The text of restored bodies: events are read as events."""
    said = F.array_join(F.transform(F.split("restored_body", "\r?\n"), lambda line: F.coalesce(
        F.get_json_object(F.substring(line, F.lit(7), F.length(line)), "$.choices[0].delta.content"), F.lit(""))), "")
    done = F.endswith("restored_body", F.lit("\r\n\r\ndata: [DONE]\r\n"))
    return restored.select("conv_id", "turn", "form", F.when(F.col("form") != "events", F.col("restored_body")).otherwise(said).alias("text"),
                           F.when(F.col("form") == "events", done).alias("ends_as_before"))


_RESTORED_SQL = f"""
    SELECT conv_id, turn, {_KIND} AS form, CASE WHEN turn % 3 < 2 THEN {_PLANTED_TURN.sql}
      ELSE text || ' key ' || {sql_token(_TURN_SECRET.sql, "'APIKEY'")} || ', again ' || {sql_token(_TURN_SECRET.sql, "'APIKEY'")} || '.' END AS text,
      CASE WHEN turn % 3 = 0 THEN true END AS ends_as_before FROM conversations"""


@query("restore_traffic", _RESTORED_SQL)
def restore_traffic_query(spark, sf):
    """Responses joined with their requests and restored by what they are: events, text, or left alone."""
    requests, responses, vault = _exchanges(spark, sf)
    return _read_back(restore_traffic(requests, responses, vault, ["conv_id", "turn"]))


@query("stream_restore_traffic", _RESTORED_SQL)
def stream_restore_traffic(spark, sf):
    """The same while both logs run: requests and responses meet in a join of two streams with a watermark."""
    requests, responses, vault = _exchanges(spark, sf)
    keys, out = ["conv_id", "turn"], shared_folder(spark, "answers")
    joined = jobs.exchange_stream(replayed(spark, requests, mixed("turn", "conv_id")), replayed(spark, responses, mixed("conv_id", "turn")), keys, "2 days")
    return _read_back(_collected(joined, jobs.restore_exchanges_to(vault, keys, out), out))
