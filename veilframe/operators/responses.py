"""Chat-completion deltas re-shaped into response events, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.spans import let
from veilframe.functions.sse import typed_number, typed_string
from veilframe.functions.text import record_id
from veilframe.operators.chunks import reassemble
from veilframe.operators.replace import join_null_safe
from veilframe.operators.ordered import SEGMENT_ROWS, running
from veilframe.session import cut_lineage

DELTA = "struct<kind:string,index:bigint,id:string,name:string,text:string>"


def _deltas(json: Column) -> Column:
    choices = F.coalesce(F.try_variant_get(json, "$.choices", "array<variant>"), F.array().cast("array<variant>"))
    choice = F.get(F.filter(choices, lambda c: F.startswith(F.schema_of_variant(c), F.lit("OBJECT"))), 0)

    def parts(c: Column) -> Column:
        content = typed_string(c, "$.delta.content")
        nothing = F.lit(None).cast("string")
        text = F.struct(F.lit("content").alias("kind"), F.lit(None).cast("bigint").alias("index"), nothing.alias("id"),
                        nothing.alias("name"), content.alias("text")).cast(DELTA)
        calls = F.coalesce(F.try_variant_get(c, "$.delta.tool_calls", "array<variant>"),
                           F.array().cast("array<variant>"))
        tools = F.transform(
            F.filter(calls, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))),
            lambda x, i: F.struct(
                F.lit("tool").alias("kind"),
                F.coalesce(typed_number(x, "$.index").cast("bigint"), i.cast("bigint")).alias("index"),
                typed_string(x, "$.id").alias("id"), typed_string(x, "$.function.name").alias("name"),
                F.coalesce(typed_string(x, "$.function.arguments"), F.lit("")).alias("text")).cast(DELTA))
        finish = F.try_variant_get(c, "$.finish_reason", "variant")
        ended = F.coalesce(F.schema_of_variant(finish) != "VOID", F.lit(False))
        return F.struct(
            F.concat(F.filter(F.array(text), lambda t: F.coalesce(t["text"] != "", F.lit(False))), tools).alias("parts"),
            ended.alias("ended"))

    return let(choice, parts)


def parse_deltas(lines: DataFrame, stream: list[str], seq: str, line: str) -> DataFrame:
    """Per line: its content and tool deltas, and whether it ends the message."""
    payload = F.when(F.startswith(F.col(line), F.lit("data: ")), F.substring(F.col(line), F.lit(7), F.length(line)))
    json = F.when(F.startswith(F.ltrim(payload), F.lit("{")), F.try_parse_json(payload))
    parsed = lines.select(*stream, seq, _deltas(json).alias("d"), F.coalesce(
        payload == "[DONE]", F.lit(False)).alias("done"))
    return parsed.select(*stream, seq, F.coalesce("d.parts", F.array().cast(f"array<{DELTA}>")).alias("parts"),
                         (F.col("done") | F.coalesce("d.ended", F.lit(False))).alias("ended"))


_CONTENT = "array<struct<type:string,text:string,annotations:array<string>>>"
_ITEM = f"struct<id:string,type:string,role:string,call_id:string,name:string,arguments:string,status:string,content:{_CONTENT}>"


def _response(key: Column, created_at: int | None, model: str | None, output: Column, text: Column, status: str) -> Column:
    """The response object as JSON; absent fields are left out."""
    return F.to_json(F.struct(
        F.concat(F.lit("resp_"), record_id(key)).alias("id"), F.lit("response").alias("object"),
        F.lit(created_at).cast("long").alias("created_at"), F.lit(model).cast("string").alias("model"), output.alias("output"),
        text.alias("output_text"), F.lit(status).alias("status")))


def response_events(lines: DataFrame, stream: list[str], seq: str, line: str, rows: int = SEGMENT_ROWS,
                    model: str | None = None, created_at: int | None = None) -> DataFrame:
    """Events of every stream: created, item and part added, deltas, done, completed.

    Sort by (stream, phase, seq, sub, part) to read them in order. ``text`` holds the delta, or the whole text or
    arguments in the closing events (one row per segment where a stream is longer than ``rows`` deltas). ``response`` is the
    response object of the events created and completed; the completed object of a stream in several segments is null, since
    no cell takes a text of any length.
    """
    parsed = parse_deltas(lines, stream, seq, line)
    has_content = F.exists("parts", lambda p: p["kind"] == "content")
    marked = running(parsed, stream, seq, sums={
        "content_before": has_content.cast("long"), "ended_before": F.col("ended").cast("long")})
    # In a line the content comes before its tool deltas.
    deltas = marked.select(
        *stream, seq, F.col("content_before").alias("lines_before"), has_content.alias("in_line"), "ended_before",
        F.posexplode("parts").alias("sub", "p"),
    ).select(
        *stream, seq, "sub", "ended_before", "p.*",
        (F.col("lines_before") + F.when((F.col("p.kind") == "tool") & F.col("in_line"), 1).otherwise(0))
        .alias("content_before"))
    deltas = cut_lineage(deltas)  # read by every kind of event below
    stream_key = F.concat_ws(":", *stream)
    message_id = F.concat(F.lit("msg_"), record_id(stream_key))

    content = deltas.filter("kind = 'content'")
    tool = deltas.filter("kind = 'tool'")
    place = F.struct(F.col(seq).alias("seq"), F.col("sub").alias("sub"))
    keys = [*stream, "index"]
    heads = tool.groupBy(*keys).agg(
        F.min(place).alias("first"), F.min_by("id", place).alias("id"), F.min_by("name", place).alias("first_name"),
        F.max_by("name", F.when(F.col("name") != "", place)).alias("last_name"),
        F.min_by(F.col("content_before") > 0, place).alias("after_content"),
    )
    rank = F.row_number().over(Window.partitionBy(*stream).orderBy("first")) - 1
    heads = heads.withColumn("output_index", rank + F.col("after_content").cast("int")).withColumn(
        "item_id", F.concat(F.lit("fc_"), record_id(F.concat_ws(":", *keys)))).withColumn(
        "call_id", F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("call_"), record_id(F.concat_ws(":", *keys)))))

    def event(df: DataFrame, phase: int, at, sub, part: int, type_: str, index, item, text, name=None, call=None,
              segment=None, response=None) -> DataFrame:
        none = F.lit(None).cast("string")
        return df.select(
            *stream, F.lit(phase).alias("phase"), at.cast("long").alias("seq"), sub.cast("long").alias("sub"),
            F.lit(part).alias("part"), F.lit(type_).alias("type"), index.cast("int").alias("output_index"),
            (none if item is None else item).alias("item_id"), (none if text is None else text).alias("text"),
            (none if name is None else name).alias("name"), (none if call is None else call).alias("call_id"),
            (F.lit(0) if segment is None else segment).cast("long").alias("segment"),
            (none if response is None else response).alias("response"))

    zero, c = F.lit(0), F.col
    ids = lines.select(*stream).distinct()
    opening = content.filter("content_before = 0")
    tool_rows = tool.join(heads.select(*keys, "first", "output_index", "item_id", "call_id"), keys)
    first_rows = tool_rows.filter((c("first")["seq"] == c(seq)) & (c("first")["sub"] == c("sub")))
    tool_name = F.coalesce(c("name"), F.lit("tool"))
    streamed = [
        event(ids, 0, zero, zero, 0, "response.created", zero, None, None,
              response=_response(stream_key, created_at, model, F.array().cast("array<string>"), F.lit(""), "in_progress")),
        event(opening, 1, c(seq), c("sub"), 0, "response.output_item.added", zero, message_id, None),
        event(opening, 1, c(seq), c("sub"), 1, "response.content_part.added", zero, message_id, F.lit("")),
        event(content, 1, c(seq), c("sub"), 2, "response.output_text.delta", zero, message_id, c("text")),
        event(first_rows, 1, c(seq), c("sub"), 0, "response.output_item.added", c("output_index"), c("item_id"), None,
              tool_name, c("call_id")),
        event(tool_rows.filter("text <> ''"), 1, c(seq), c("sub"), 2, "response.function_call_arguments.delta",
              c("output_index"), c("item_id"), c("text")),
    ]
    # Closing events carry what had arrived when the stream ended.
    whole = reassemble(content.filter("ended_before = 0"), stream, seq, "text", rows)
    for part, type_ in enumerate(
            ("response.output_text.done", "response.content_part.done", "response.output_item.done")):
        streamed.append(event(whole, 2, zero, zero, part, type_, zero, message_id, c("text"), segment=c("segment")))
    arguments = reassemble(tool.filter("ended_before = 0"), keys, seq, "text", rows).join(heads, keys)
    final_name = F.coalesce(c("last_name"), c("first_name"), F.lit("tool"))
    for part, type_ in enumerate(("response.function_call_arguments.done", "response.output_item.done")):
        streamed.append(event(arguments, 2, F.lit(1), c("output_index"), part, type_, c("output_index"), c("item_id"),
                              c("text"), final_name, c("call_id"), c("segment")))
    nothing = F.lit(None).cast("string")
    said = F.struct(F.lit("output_text").alias("type"), c("text").alias("text"), F.array().cast("array<string>").alias("annotations"))
    message = F.struct(message_id, F.lit("message"), F.lit("assistant"), nothing, nothing, nothing, F.lit("completed"), F.array(said)).cast(_ITEM)
    call = F.struct(c("item_id"), F.lit("function_call"), nothing, c("call_id"), final_name, c("text"), F.lit("completed"),
                    F.lit(None).cast(_CONTENT)).cast(_ITEM)
    # A message comes first even where a call holds the same output index.
    items = whole.select(*stream, F.lit(-1).alias("place"), "segment", message.alias("item")).unionByName(
        arguments.select(*stream, c("output_index").cast("int").alias("place"), "segment", call.alias("item")))
    short = items.groupBy(*stream).agg(
        F.max("segment").alias("longest"), F.array_sort(F.collect_list(F.when(c("segment") == 0, F.struct("place", "item")))).alias("items"))
    closed = join_null_safe(ids, short, stream, "left")
    output = F.coalesce(F.transform("items", lambda i: i["item"]), F.array().cast(f"array<{_ITEM}>"))
    first = F.get(output, 0)
    text = F.when(first["type"] == "message", F.get(first["content"], 0)["text"])
    streamed.append(event(closed, 3, zero, zero, 0, "response.completed", zero, None, None, response=F.when(
        F.coalesce(c("longest"), zero) == 0, _response(stream_key, created_at, model, output, text, "completed"))))
    out = streamed[0]
    for more in streamed[1:]:
        out = out.unionByName(more)
    return out
