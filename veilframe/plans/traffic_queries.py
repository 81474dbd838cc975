"""Queries of sessions, chunk streams, frames and API traffic."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.config import DetectOptions
from veilframe.functions.chat import chat_request_json, joined_text, to_chat_request, to_response
from veilframe.functions.http import drop_hop_headers, is_sse, is_text_content, redact_headers, route_provider
from veilframe.functions.sse import sse_data, sse_text_fields
from veilframe.functions.text import vault_token
from veilframe.operators.chunks import (
    frames_to_messages, inspected_arguments, reassemble, system_runs, token_safe, tool_calls,
)
from veilframe.operators.findings import findings
from veilframe.operators.mask import mask_as_of
from veilframe.operators.responses import response_events
from veilframe.operators.restore import restore
from veilframe.operators.sessions import flag_new, window_findings, window_text
from veilframe.operators.threads import chat_requests_with_history, thread_history, thread_index
from veilframe.operators.vault import build_vault, sightings
from veilframe.plans.pipelines import mask_traffic
from veilframe.plans.registry import SESSION, Injected, query, table, utc
from veilframe.plans.vault_queries import sql_token
from veilframe.session import cut_lineage, spread
from veilframe.sources.capture import capture_record

CHUNK = 7


def turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


# ---- sessions ----------------------------------------------------------------------------------------------------

# One secret per conversation: named in turn 1, and mentioned without a keyword in every turn.
_SAID = Injected("{col:text} see {c:10}{col:CASE WHEN turn = 1 THEN ' password = \"' || @C || '\"' ELSE '' END}", "conv_id")


def _said(spark_side: bool) -> str:
    return _SAID.expression(spark_side).replace("@C", Injected("{c:10}", "conv_id").expression(spark_side))


_C = Injected("{c:10}", "conv_id").sql


@query("session_asof_mask", f"""
    SELECT conv_id, turn, CASE WHEN turn >= 1 THEN replace(t, c, {sql_token('c', "'PASSWORD'")}) ELSE t END AS masked_text
    FROM (SELECT conv_id, turn, {_said(False)} AS t, {_C} AS c FROM conversations)""")
def session_asof_mask(spark, sf):
    said = turns(spark, sf).select("conv_id", "turn", F.expr(_said(True)).alias("text"))
    found = cut_lineage(findings(said, ["conv_id", "turn"], "text", DetectOptions(entropy=False)))
    events = sightings(found, "stdin", F.timestamp_seconds(F.col("turn")), ["turn", "start"], scope=["conv_id"])
    vault = build_vault(events, SESSION, scope=["conv_id"])
    since = found.groupBy("conv_id", F.col("value").alias("secret")).agg(F.min("turn").alias("first_turn"))
    known = cut_lineage(vault.join(since, ["conv_id", "secret"]))
    return mask_as_of(said, known, ["conv_id"], ["conv_id", "turn"], "turn", "first_turn", "text", "masked_text").select(
        "conv_id", "turn", "masked_text")


@query("rolling_window_text", """
    SELECT conv_id, turn, right(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 4096) AS window_text
    FROM conversations""")
def rolling_window_text(spark, sf):
    return window_text(turns(spark, sf), ["conv_id"], "turn", "text").select("conv_id", "turn", "window_text")


@query("rolling_window_short", """
    SELECT conv_id, turn, right(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 300) AS window_text
    FROM conversations""")
def rolling_window_short(spark, sf):
    return window_text(turns(spark, sf), ["conv_id"], "turn", "text", window=300).select("conv_id", "turn", "window_text")


_SPLIT = Injected("{col:CASE WHEN turn = 0 THEN text || ' password = ' ELSE @C || '; ' || text END}", "conv_id")


@query("window_findings", f"""
    SELECT conv_id, turn, {_C} AS value, 'PASSWORD' AS type FROM (
      SELECT conv_id, turn, coalesce(sum(length(text) + 12) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS n,
        min(CASE WHEN turn = 0 THEN length(text) END) OVER (PARTITION BY conv_id) AS n0 FROM conversations)
    WHERE turn >= 1 AND n - n0 - 1 <= 4096""")
def window_findings_query(spark, sf):
    """A password split over two turns is found in the window as long as its keyword (behind a blank) is inside."""
    expression = _SPLIT.expression(True).replace("@C", Injected("{c:10}", "conv_id").expression(True))
    said = turns(spark, sf).select("conv_id", "turn", F.expr(expression).alias("text"))
    found = window_findings(said, ["conv_id"], "turn", "text", DetectOptions(patterns=False, entropy=False))
    secret = Injected("{c:10}", "conv_id").spark
    return found.withColumn("c", secret).filter("value = c").select("conv_id", "turn", "value", "type")


@query("new_findings", """
    SELECT user_id, event_id, event_type AS value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS is_new
    FROM events""")
def new_findings(spark, sf):
    found = table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("value"),
                                              F.lit("GENERIC").alias("type"))
    return flag_new(found, ["user_id"], ["event_id"]).select("user_id", "event_id", "value", "is_new")


@query("argv_gate", """
    SELECT user_id, event_id, coalesce(lag(arg) OVER (PARTITION BY user_id ORDER BY event_id) NOT IN ('-c', '--eval'), true) AS inspected
    FROM (SELECT *, CASE event_type WHEN 'error' THEN '-c' WHEN 'signup' THEN '--eval' ELSE props END AS arg FROM events)""")
def argv_gate(spark, sf):
    arg = F.expr("CASE event_type WHEN 'error' THEN '-c' WHEN 'signup' THEN '--eval' ELSE props END")
    argv = table(spark, sf, "events").select("user_id", "event_id", arg.alias("arg"))
    return inspected_arguments(argv, ["user_id"], "event_id", "arg").select("user_id", "event_id", "inspected")


@query("merge_system_messages", """
    WITH m AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'system' ELSE 'user' END AS role, props FROM events),
    s AS (SELECT *, CASE WHEN role = 'system' AND coalesce(lag(role) OVER w, '') = 'system' THEN 0 ELSE 1 END AS starts FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM s)
    SELECT user_id, min(event_id) AS first_order, any_value(role) AS role, string_agg(props, chr(10) || chr(10) ORDER BY event_id) AS text, count(*) AS n_merged,
           0::BIGINT AS part
    FROM r GROUP BY user_id, run""")
def merge_system_messages(spark, sf):
    role = F.when(F.col("event_type").isin("view", "click"), "system").otherwise("user")
    messages = table(spark, sf, "events").select("user_id", "event_id", role.alias("role"), F.col("props").alias("text"))
    return system_runs(messages, ["user_id"], "event_id", "role", "text")


# ---- chunks, frames, tool calls ----------------------------------------------------------------------------------

def chunked(df, keys, text="text", size=CHUNK):
    """Text cut into pieces of ``size`` characters, numbered from 0."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"[\s\S]{{1,{size}}}"), F.lit(0))
    return df.select(*keys, F.posexplode(pieces).alias("seq", "chunk")).withColumn("seq", F.col("seq").cast("long"))


@query("chunks_reassemble", f"""
    SELECT conv_id, turn, CAST(0 AS BIGINT) AS segment, text, CAST(ceil(length(text) / {CHUNK}.0) AS BIGINT) AS n_chunks
    FROM conversations WHERE length(text) > 0""")
def chunks_reassemble(spark, sf):
    return reassemble(chunked(turns(spark, sf), ["conv_id", "turn"]), ["conv_id", "turn"], "seq", "chunk")


_PLANTED_TURN = Injected("{col:text} key ghp_{k:36}, again ghp_{k:36}.", "conv_id")
_TURN_TOKEN_SQL = sql_token(Injected("ghp_{k:36}", "conv_id").sql, "'APIKEY'")


def _tokenised(spark, sf):
    """Turns that carry tokens, and the vault behind the tokens."""
    secret = Injected("ghp_{k:36}", "conv_id").spark
    token = vault_token(secret, F.lit("APIKEY"), F.lit(SESSION))
    base = turns(spark, sf)
    texts = base.select("conv_id", "turn", F.concat("text", F.lit(" key "), token, F.lit(", again "), token, F.lit(".")).alias("text"))
    vault = base.select(token.alias("token"), secret.alias("secret")).distinct()
    return texts, cut_lineage(vault)


@query("segments_restore", f"""
    SELECT conv_id, turn, 0::BIGINT AS segment, {_PLANTED_TURN.sql} AS text FROM conversations""")
def segments_restore(spark, sf):
    """Streams of many chunks come as segments; tokens across segment borders are restored as well."""
    texts, vault = _tokenised(spark, sf)
    keys = ["conv_id", "turn"]
    segments = token_safe(reassemble(chunked(texts, keys), keys, "seq", "chunk", rows=16), keys)
    whole = restore(segments, vault, [*keys, "segment"], "text", "restored")
    return reassemble(whole, keys, "segment", "restored").select("conv_id", "turn", "segment", "text")


@query("tool_call_assembly", """
    WITH d AS (SELECT user_id, event_id, CAST(length(event_type) % 3 AS BIGINT) AS idx, CASE WHEN event_type IN ('signup', 'purchase') THEN 'c' || event_id ELSE '' END AS id,
      CASE event_type WHEN 'click' THEN 'f' || event_id WHEN 'error' THEN '' END AS name, props AS arguments FROM events),
    g AS (SELECT user_id, idx, coalesce(nullif((array_agg(id ORDER BY event_id))[1], ''), 'call_' || substr(sha256(user_id || ':' || idx), 1, 12)) AS call_id,
      coalesce(arg_max(name, event_id) FILTER (name <> ''), (array_agg(name ORDER BY event_id))[1], 'tool') AS name,
      min(event_id) AS f, string_agg(arguments, '' ORDER BY event_id) AS arguments, count(*) AS n_chunks FROM d GROUP BY user_id, idx)
    SELECT user_id, idx AS "index", call_id, name, CAST(row_number() OVER (PARTITION BY user_id ORDER BY f, idx) - 1 AS INTEGER) AS output_index,
      CAST(0 AS BIGINT) AS segment, arguments, n_chunks FROM g""")
def tool_call_assembly(spark, sf):
    deltas = table(spark, sf, "events").select(
        "user_id", "event_id", (F.length("event_type") % 3).cast("long").alias("index"),
        F.when(F.col("event_type").isin("signup", "purchase"), F.concat(F.lit("c"), F.col("event_id").cast("string"))).otherwise("").alias("id"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("f"), F.col("event_id").cast("string")))
        .when(F.col("event_type") == "error", "").alias("name"),
        F.col("props").alias("arguments"))
    return tool_calls(deltas, ["user_id"], "event_id")


@query("frames_to_messages", """
    WITH f AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 9 ELSE 0 END AS opcode, value > 30 AS fin, props FROM events),
    n AS (SELECT *, coalesce(sum(CAST(opcode IN (0, 1) AND fin AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS message FROM f),
    o AS (SELECT *, max(CASE WHEN opcode = 1 THEN message END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened FROM n)
    SELECT user_id, CAST(message AS BIGINT) AS message, CAST(0 AS BIGINT) AS segment, string_agg(props, '' ORDER BY event_id) AS text, count(*) AS n_chunks
    FROM o WHERE opcode = 1 OR (opcode = 0 AND opened = message) GROUP BY user_id, message""")
def frames_to_messages_query(spark, sf):
    opcode = F.expr("CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 9 ELSE 0 END")
    frames = table(spark, sf, "events").select("user_id", "event_id", opcode.alias("opcode"), (F.col("value") > 30).alias("fin"),
                                               F.col("props").alias("payload"))
    return frames_to_messages(frames, ["user_id"], "event_id")


# ---- HTTP --------------------------------------------------------------------------------------------------------

_HEADERS = [("Authorization", "'Bearer ' || o_orderkey"), ("Connection", "'close'"), ("X-Status", "o_orderstatus"),
            ("cookie", "'a=' || o_custkey"), ("Keep-Alive", "'5'"), ("x-api-key", "'k'"), ("TE", "'gzip'")]


def _order_headers(spark, sf):
    pairs = ", ".join(f"'{k}', array({v})" for k, v in _HEADERS)
    return table(spark, sf, "orders").select("o_orderkey", F.expr(f"map({pairs})").alias("headers"))


def _flat(headers):
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(
        e["key"], F.lit("="), F.get(e["value"], 0))), ";")


@query("redact_headers", """
    SELECT o_orderkey, 'Authorization=<redacted>;Connection=close;Keep-Alive=5;TE=gzip;X-Status=' || o_orderstatus || ';cookie=<redacted>;x-api-key=<redacted>' AS headers FROM orders""")
def redact_headers_query(spark, sf):
    return _order_headers(spark, sf).select("o_orderkey", _flat(redact_headers(F.col("headers"))).alias("headers"))


@query("drop_hop_headers", """
    SELECT o_orderkey, 'Authorization=Bearer ' || o_orderkey || ';X-Status=' || o_orderstatus || ';cookie=a=' || o_custkey || ';x-api-key=k' AS headers,
      'Authorization=Bearer ' || o_orderkey || ';Connection=close;X-Status=' || o_orderstatus || ';cookie=a=' || o_custkey || ';x-api-key=k' AS upgrade_headers FROM orders""")
def drop_hop_headers_query(spark, sf):
    return _order_headers(spark, sf).select(
        "o_orderkey", _flat(drop_hop_headers(F.col("headers"))).alias("headers"),
        _flat(drop_hop_headers(F.col("headers"), keep_upgrade=True)).alias("upgrade_headers"))


_KINDS = {"1-URGENT": "text/html; charset=x", "2-HIGH": "application/vnd.api+JSON", "3-MEDIUM": "image/png",
          "4-NOT SPECIFIED": "text/event-stream"}


@query("content_kinds", """
    SELECT o_orderkey, o_orderpriority <> '3-MEDIUM' AS is_text, o_orderpriority = '4-NOT SPECIFIED' AS is_sse FROM orders""")
def content_kinds(spark, sf):
    cases = " ".join(f"WHEN '{k}' THEN map('content-type', array('{v}'))" for k, v in _KINDS.items())
    headers = F.expr(f"CASE o_orderpriority {cases} ELSE map('host', array('h')) END")
    return table(spark, sf, "orders").select("o_orderkey", headers.alias("h")).select(
        "o_orderkey", is_text_content(F.col("h")).alias("is_text"), is_sse(F.col("h")).alias("is_sse"))


@query("route_provider", """
    SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'anthropic' WHEN o_orderpriority = '2-HIGH' THEN 'openai'
        WHEN o_orderstatus = 'F' THEN 'anthropic' WHEN o_orderstatus = 'P' THEN 'openai'
        WHEN o_orderpriority = '3-MEDIUM' THEN 'anthropic' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'openai' END AS provider,
      CASE o_orderpriority WHEN '1-URGENT' THEN '/v1/x' WHEN '2-HIGH' THEN '/' WHEN '3-MEDIUM' THEN '/V1/messages?b=1'
        WHEN '4-NOT SPECIFIED' THEN '/responses' ELSE '/anthropics/v1' END AS upstream_path,
      CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN 'unresolved provider' END AS error FROM orders""")
def route_provider_query(spark, sf):
    path = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN '/anthropic/v1/x' WHEN '2-HIGH' THEN '/openai' "
                  "WHEN '3-MEDIUM' THEN 'V1/messages?b=1' WHEN '4-NOT SPECIFIED' THEN '/responses' ELSE '/anthropics/v1' END")
    headers = F.expr("CASE o_orderstatus WHEN 'F' THEN map('x-api-key', array('k'), 'authorization', array('b')) "
                     "WHEN 'P' THEN map('authorization', array('b')) ELSE map('host', array('h')) END")
    routed = table(spark, sf, "orders").select("o_orderkey", route_provider(path, headers).alias("r"))
    return routed.select("o_orderkey", "r.*")


_BODY = Injected('<"role":"{col:role}","text":"{col:@TEXT} ghp_{k:36}\\"">', "conv_id")


def _body(spark_side: bool) -> str:
    text = r"replace(text, chr(10), '\\n')" if spark_side else r"replace(text, chr(10), '\n')"
    return _BODY.expression(spark_side).replace("@TEXT", text)


@query("mask_traffic", f"""
    SELECT conv_id, turn, provider, is_text, CASE WHEN is_text THEN replace(body, s, {sql_token('s', "'APIKEY'")}) ELSE body END AS masked_body
    FROM (SELECT conv_id, turn, {_body(False)} AS body, {Injected('ghp_{k:36}', 'conv_id').sql} AS s,
      CASE role WHEN 'user' THEN 'anthropic' WHEN 'assistant' THEN 'openai' END AS provider, role = 'user' AS is_text FROM conversations)""")
def mask_traffic_query(spark, sf):
    log = turns(spark, sf).select(
        "conv_id", "turn", F.expr(_body(True)).alias("body"),
        F.expr("CASE role WHEN 'user' THEN '/v1/messages' WHEN 'assistant' THEN '/v1/chat/completions' ELSE '/x' END").alias("path"),
        F.expr("CASE role WHEN 'assistant' THEN map('content-type', array('image/png')) ELSE map('content-type', array('application/json')) END").alias("headers"))
    result = mask_traffic(log, ["conv_id", "turn"], SESSION, F.timestamp_seconds(F.col("turn")), DetectOptions(entropy=False))
    return result.texts.select("conv_id", "turn", "route.provider", F.col("is_text"), "masked_body")


@query("capture_records", """
    SELECT o_orderkey, '/v1/' || o_orderstatus AS path, '<redacted>' AS auth, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS STRING) END AS body_a,
      CASE WHEN o_orderstatus = 'O' THEN 'not json ' || o_orderkey WHEN o_orderstatus = 'F' THEN '{"a":' || o_custkey || '}' END AS body, CAST(o_custkey % 500 AS STRING) AS status FROM orders""")
def capture_records(spark, sf):
    body = F.expr("CASE o_orderstatus WHEN 'O' THEN 'not json ' || o_orderkey WHEN 'F' THEN '{\"a\":' || o_custkey || '}' ELSE '' END")
    headers = F.expr("map('Authorization', array('Bearer x'))")
    record = capture_record(headers, F.concat(F.lit("/v1/"), "o_orderstatus"), body, headers, F.col("o_custkey") % 500, F.lit("{}"))
    records = table(spark, sf, "orders").select("o_orderkey", record.alias("r"))
    get = F.get_json_object
    return records.select("o_orderkey", get("r", "$.client_path").alias("path"), get("r", "$.client_headers.Authorization[0]").alias("auth"),
                          get("r", "$.client_request_body.a").alias("body_a"), get("r", "$.client_request_body").alias("body"),
                          get("r", "$.response_status_code").alias("status"))


# ---- server-sent events ------------------------------------------------------------------------------------------

@query("sse_data_lines", """
    SELECT event_id, CASE event_type WHEN 'view' THEN 'data: ' WHEN 'click' THEN 'data:' WHEN 'error' THEN 'data: ' WHEN 'signup' THEN 'data: ' END AS prefix,
      CASE event_type WHEN 'view' THEN props WHEN 'click' THEN props WHEN 'error' THEN '[DONE]' WHEN 'signup' THEN '{"k":' END AS payload,
      event_type = 'error' AS done, event_type IN ('view', 'click') AS parsed FROM events""")
def sse_data_lines(spark, sf):
    line = F.expr("CASE event_type WHEN 'view' THEN 'data: ' || props WHEN 'click' THEN 'data:' || props WHEN 'error' THEN 'data: [DONE]' "
                  "WHEN 'signup' THEN 'data: {\"k\":' ELSE 'event: x' END")
    data = table(spark, sf, "events").select("event_id", sse_data(line).alias("d"))
    return data.select("event_id", "d.prefix", "d.payload", "d.done", F.col("d.json").isNotNull().alias("parsed"))


_ANTHROPIC = "<\"index\":{col:user_id},\"delta\":<\"text\":\"t{col:event_id}\",\"partial_json\":5>,\"content_block\":<\"text\":\"b\">,\"completion\":\"c\">"
_OPENAI = ("<\"choices\":[<\"text\":\"t{col:event_id}\">,7,<\"index\":9,\"delta\":<\"content\":\"d\",\"function_call\":<\"arguments\":\"f\">,"
           "\"tool_calls\":[<\"index\":4,\"function\":<\"arguments\":\"x\">>,<\"function\":<\"arguments\":\"y\">>]>>]>")


@query("sse_text_fields", """
    SELECT event_id, key, value FROM (
      SELECT event_id, 'anthropic:' || user_id || ':delta.text' AS key, 't' || event_id AS value FROM events UNION ALL
      SELECT event_id, 'anthropic:' || user_id || ':content_block.text', 'b' FROM events UNION ALL
      SELECT event_id, 'anthropic:completion', 'c' FROM events UNION ALL
      SELECT event_id, 'openai:0:text', 't' || event_id FROM events UNION ALL
      SELECT event_id, 'openai:9:delta.content', 'd' FROM events UNION ALL
      SELECT event_id, 'openai:9:delta.function_call.arguments', 'f' FROM events UNION ALL
      SELECT event_id, 'openai:9:delta.tool_calls.4.function.arguments', 'x' FROM events UNION ALL
      SELECT event_id, 'openai:9:delta.tool_calls.1.function.arguments', 'y' FROM events)""")
def sse_text_fields_query(spark, sf):
    def payload(template):
        expression = Injected(template, "event_id").expression(True)
        return F.replace(F.replace(F.expr(expression), F.lit("<"), F.lit("{")), F.lit(">"), F.lit("}"))

    lines = table(spark, sf, "events").select("event_id", "user_id", F.explode(F.array(
        F.struct(F.lit("anthropic").alias("provider"), payload(_ANTHROPIC).alias("p")),
        F.struct(F.lit("openai").alias("provider"), payload(_OPENAI).alias("p")))).alias("x"))
    fields = lines.select("event_id", F.explode(sse_text_fields(F.try_parse_json(F.col("x.p")), F.col("x.provider"))).alias("f"))
    return fields.select("event_id", "f.key", "f.value")


@query("sse_reassemble_restore", f"""
    SELECT conv_id, turn, 'anthropic:0:delta.text' AS key, 0::BIGINT AS segment, {_PLANTED_TURN.sql} AS text FROM conversations""")
def sse_reassemble_restore(spark, sf):
    """Tokens split over event deltas: text fields are put together per stream and field, then restored."""
    texts, vault = _tokenised(spark, sf)
    payload = F.to_json(F.struct(F.lit(0).alias("index"), F.struct(F.col("chunk").alias("text")).alias("delta")))
    lines = chunked(spread(texts), ["conv_id", "turn"]).select("conv_id", "turn", "seq", F.concat(F.lit("data: "), payload).alias("line"))
    fields = lines.select("conv_id", "turn", "seq", F.explode(sse_text_fields(
        sse_data(F.col("line"))["json"], F.lit("anthropic"))).alias("f")).select("conv_id", "turn", "seq", "f.key", "f.value")
    keys = ["conv_id", "turn", "key"]
    segments = token_safe(reassemble(cut_lineage(fields), keys, "seq", "value"), keys)
    return restore(segments, vault, [*keys, "segment"], "text", "restored").select(
        "conv_id", "turn", "key", "segment", F.col("restored").alias("text"))


@query("response_events", f"""
    SELECT conv_id, turn, type, CAST(n AS BIGINT) AS n_events, CASE WHEN type = 'response.output_text.done' THEN text END AS text FROM conversations,
    LATERAL (VALUES ('response.created', 1), ('response.output_item.added', 1), ('response.content_part.added', 1),
      ('response.output_text.delta', CAST(ceil(length(text) / {CHUNK}.0) AS INTEGER)), ('response.output_text.done', 1), ('response.content_part.done', 1),
      ('response.output_item.done', 1), ('response.completed', 1)) AS v(type, n)""")
def response_events_query(spark, sf):
    payload = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("chunk").alias("content")).alias("delta"))).alias("choices")))
    pieces = chunked(turns(spark, sf), ["conv_id", "turn"])
    lines = pieces.select("conv_id", "turn", "seq", F.concat(F.lit("data: "), payload).alias("line"))
    events = response_events(lines, ["conv_id", "turn"], "seq", "line")
    return events.groupBy("conv_id", "turn", "type").agg(
        F.count("*").alias("n_events"),
        F.max(F.when(F.col("type") == "response.output_text.done", F.col("text"))).alias("text"))


# ---- chat --------------------------------------------------------------------------------------------------------

def _request(spark, sf):
    """A request per turn: instructions, a developer message, the turn's text in parts, a call and its result."""
    text = F.struct(F.lit("input_text").alias("type"), F.col("text").alias("text"))
    entries = F.array(
        F.to_json(F.struct(F.lit("developer").alias("role"), F.lit("rules").alias("content"))),
        F.to_json(F.struct(F.lit("user").alias("role"), F.array(text, text).alias("content"))),
        F.to_json(F.struct(F.lit("function_call").alias("type"), F.lit("look").alias("name"), F.lit("c1").alias("call_id"),
                           F.lit('{"a":1}').alias("arguments"))),
        F.to_json(F.struct(F.lit("function_call_output").alias("type"), F.lit("c1").alias("call_id"), F.lit("done").alias("output"))))
    body = F.concat(
        F.lit('{"model":"m","instructions":"be brief","tool_choice":"auto","temperature":0.5,"stream":true,'
              '"tools":[{"type":"function","name":"look","strict":true},{"type":"web"},{"type":"function","name":""}],'
              '"max_output_tokens":'), F.col("turn").cast("string"), F.lit(',"max_tokens":77,"input":['), F.array_join(entries, ","), F.lit("]}"))
    return turns(spark, sf).select("conv_id", "turn", to_chat_request(body).alias("r"))


@query("chat_request_normalize", """
    SELECT conv_id, turn, CAST(4 AS INTEGER) AS n_messages, 'be brief' || chr(10) || chr(10) || 'rules' AS system_text, text || text AS user_text,
      'look' AS call_name, 'done' AS tool_text, CASE WHEN turn > 0 THEN turn ELSE 77 END::DOUBLE AS max_tokens, CAST(1 AS INTEGER) AS n_tools,
      true AS no_choice, CAST(0.5 AS DOUBLE) AS temperature, true AS stream FROM conversations""")
def chat_request_normalize(spark, sf):
    m = F.col("r.messages")
    return _request(spark, sf).select(
        "conv_id", "turn", F.size(m).alias("n_messages"), joined_text(m[0]).alias("system_text"), m[1]["text"].alias("user_text"),
        m[2]["tool_calls"][0]["function"]["name"].alias("call_name"), m[3]["text"].alias("tool_text"), "r.max_tokens",
        F.size("r.tools").alias("n_tools"), F.col("r.tool_choice").isNull().alias("no_choice"), "r.temperature", "r.stream")


@query("chat_request_wire", """
    SELECT conv_id, turn, 'system' AS role0, 'be brief' || chr(10) || chr(10) || 'rules' AS content0, 'c1' AS call_id, 'look' AS tool,
      CAST(CASE WHEN turn > 0 THEN turn ELSE 77 END AS STRING) AS max_tokens, true AS no_choice FROM conversations""")
def chat_request_wire(spark, sf):
    wire = _request(spark, sf).select("conv_id", "turn", chat_request_json(F.col("r")).alias("w"))
    get = F.get_json_object
    return wire.select(
        "conv_id", "turn", get("w", "$.messages[0].role").alias("role0"), get("w", "$.messages[0].content").alias("content0"),
        get("w", "$.messages[3].tool_call_id").alias("call_id"), get("w", "$.tools[0].function.name").alias("tool"),
        get("w", "$.max_tokens").alias("max_tokens"), get("w", "$.tool_choice").isNull().alias("no_choice"))


@query("chat_completion_items", """
    SELECT conv_id, turn, CAST(CASE WHEN role = 'system' THEN 1 ELSE 2 END AS INTEGER) AS n_items, CASE WHEN role <> 'system' THEN text END AS output_text,
      'look' AS call_name, '{"a":1}' AS call_arguments, 'completed' AS status FROM conversations""")
def chat_completion_items(spark, sf):
    content = F.when(F.col("role") != "system", F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))
    message = F.struct(content.alias("content"), F.array(F.struct(F.lit("c1").alias("id"), F.struct(
        F.lit("look").alias("name"), F.lit('{"a":1}').alias("arguments")).alias("function"))).alias("tool_calls"))
    body = F.to_json(F.struct(F.lit("m").alias("model"), F.array(F.struct(message.alias("message"))).alias("choices")))
    made = turns(spark, sf).select("conv_id", "turn", to_response(body, F.concat_ws("-", "conv_id", "turn")).alias("r"))
    last = F.element_at("r.output", -1)
    return made.select("conv_id", "turn", F.size("r.output").alias("n_items"), "r.output_text", last["name"].alias("call_name"),
                       last["arguments"].alias("call_arguments"), "r.status")


def _responses(spark, sf):
    """Every turn is a response that continues the one before it; first turns name one that is not stored."""
    return turns(spark, sf).select(
        F.concat_ws("-", "conv_id", "turn").alias("response_id"),
        F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("previous_id"), "text")


@query("thread_index", """
    SELECT conv_id || '-' || turn AS response_id, conv_id || '-0' AS root, turn AS depth FROM conversations""")
def thread_index_query(spark, sf):
    return thread_index(_responses(spark, sf), "response_id", "previous_id")


@query("thread_history", """
    SELECT conv_id || '-' || last_turn AS response_id, turn AS position, conv_id || '-' || turn AS from_response, text
    FROM conversations JOIN (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id) USING (conv_id)""")
def thread_history_query(spark, sf):
    return thread_history(_responses(spark, sf), "response_id", "previous_id", ["text"])


def _request_log(spark, sf):
    """Every turn continues the one before it. The second turn is stored twice, first with another text; the first names a
    response that is not stored."""
    def made(frame, order, text):
        request = F.to_json(F.struct(F.lit("m").alias("model"), F.lit("be brief").alias("instructions"), text.alias("input")))
        message = F.struct(F.struct(F.concat(F.lit("re "), F.col("turn").cast("string")).alias("content")).alias("message"))
        return frame.select(
            F.concat_ws("-", "conv_id", "turn").alias("response_id"), F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("previous_id"),
            order.cast("long").alias("asked"), request.alias("request"), F.to_json(F.struct(F.array(message).alias("choices"))).alias("response"))

    base, place = turns(spark, sf), F.col("conv_id") * 1_000_000 + F.col("turn") * 10
    return made(base, place, F.col("text")).unionByName(made(base.where("turn = 1"), place - 5, F.lit("old")))


@query("chat_request_with_history", """
    WITH RECURSIVE versions AS (
      SELECT conv_id || '-' || turn AS response_id, conv_id || '-' || (turn - 1) AS previous_id, conv_id * 1000000 + turn * 10 AS asked, text, turn FROM conversations
      UNION ALL SELECT conv_id || '-' || turn, conv_id || '-' || (turn - 1), conv_id * 1000000 + turn * 10 - 5, 'old', turn FROM conversations WHERE turn = 1),
    parents AS (SELECT v.*, (SELECT max(p.asked) FROM versions p WHERE p.response_id = v.previous_id AND p.asked < v.asked) AS parent FROM versions v),
    threads AS (
      SELECT asked, 'be brief|' || text AS said, 2 AS n, '|re ' || turn AS reply FROM parents WHERE parent IS NULL
      UNION ALL SELECT v.asked, t.said || t.reply || '|' || v.text, t.n + 2, '|re ' || v.turn FROM threads t JOIN parents v ON v.parent = t.asked)
    SELECT p.response_id, p.asked, CASE WHEN p.parent IS NULL THEN 0 ELSE 1 END::BIGINT AS n_segments, t.n::INTEGER AS n_messages, t.said, 'm' AS model
    FROM threads t JOIN parents p USING (asked) WHERE p.asked NOT IN (SELECT parent FROM parents WHERE parent IS NOT NULL)""")
def chat_request_with_history(spark, sf):
    """Requests composed with the history they continue, each id as it was stored when the request came."""
    asked = chat_requests_with_history(_request_log(spark, sf), "response_id", "previous_id", "asked", "request", "response")
    texts = F.transform("chat.messages", lambda m: joined_text(m))
    return asked.select("response_id", "asked", "n_segments", F.size("chat.messages").alias("n_messages"), F.array_join(texts, "|").alias("said"), "chat.model")


# ---- traffic of a session ----------------------------------------------------------------------------------------

_KNOWN = Injected("stored-{d:12}", "conv_id")
_SESSION_BODY = f"({_said(False)} || ' ' || {_KNOWN.sql})"


@query("mask_traffic_session", f"""
    SELECT conv_id, turn, CASE WHEN turn >= 1 THEN replace(t, c, {sql_token('c', "'PASSWORD'")}) ELSE t END AS masked_body FROM (
      SELECT conv_id, turn, {_C} AS c,
             CASE WHEN conv_id % 2 = 0 THEN replace(b, k, '__VAULT_GENERIC_' || substr(sha256(k), 1, 8) || '__') ELSE b END AS t
      FROM (SELECT conv_id, turn, {_SESSION_BODY} AS b, {_KNOWN.sql} AS k FROM conversations))""")
def mask_traffic_session(spark, sf):
    """Each turn as a request: a secret named in one turn masks later ones, and none before; stored secrets mask all."""
    body = F.concat(F.expr(_said(True)), F.lit(" "), _KNOWN.spark)
    log = turns(spark, sf).select(
        "conv_id", "turn", F.lit("/v1/messages").alias("path"), body.alias("body"),
        F.create_map(F.lit("Content-Type"), F.array(F.lit("application/json"))).alias("headers"))
    token = F.concat(F.lit("__VAULT_GENERIC_"), F.substring(F.sha2("secret", 256), 1, 8), F.lit("__"))
    stored = turns(spark, sf).where("conv_id % 2 = 0").select(_KNOWN.spark.alias("secret")).distinct().select(
        token.alias("token"), "secret", F.lit("GENERIC").alias("type"), F.timestamp_seconds(F.lit(0)).alias("created_at"),
        F.lit(0).cast("long").alias("hit_count"), F.lit(None).cast("string").alias("name"), F.lit("manual").alias("source"))
    run = mask_traffic(log, ["conv_id", "turn"], SESSION, F.timestamp_seconds(F.col("turn")), DetectOptions(patterns=False, entropy=False),
                       scope=["conv_id"], order="turn", known_vault=stored)
    return run.texts.select("conv_id", "turn", "masked_body")
