"""Normalisation of logged chat requests and completions. JSON comes in as text and is read through variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.spans import let
from veilframe.functions.sse import typed_number, typed_string
from veilframe.functions.text import js_trim

DEFAULT_MAX_TOKENS = 4096  # fixed value
PART = "struct<type:string,text:string,image_url:struct<url:string>>"
CONTENT = f"struct<text:string,parts:array<{PART}>>"
CALL = "struct<id:string,type:string,function:struct<name:string,arguments:string>>"
MESSAGE = (
    f"struct<role:string,text:string,parts:array<{PART}>,tool_call_id:string,tool_calls:array<{CALL}>>"
)


def normalize_role(role: Column) -> Column:
    return F.when(role.isin("assistant", "system", "tool", "user"), role).when(role == "developer", "system")


def as_text(value: Column) -> Column:
    """A string as it is, nothing for null, other values as JSON text."""
    kind = F.schema_of_variant(value)
    return F.when(value.isNull() | (kind == "VOID"), "").when(
        kind == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def _items(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def _is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def flatten_content(content: Column) -> Column:
    """Content as plain text where all of it is text, else as parts; unknown parts are left out."""

    def part(entry: Column) -> Column:
        kind = typed_string(entry, "$.type")
        text = F.when(_is_object(entry), F.when(
            kind.isin("input_text", "output_text", "text"), as_text(F.try_variant_get(entry, "$.text", "variant")))
        ).otherwise(as_text(entry))
        url = F.when(kind == "input_image", F.coalesce(
            typed_string(entry, "$.image_url"), typed_string(entry, "$.image_url.url")))
        return F.when(text != "", F.struct(
            F.lit("text").alias("type"), text.alias("text"),
            F.lit(None).cast("struct<url:string>").alias("image_url"))
        ).when(url != "", F.struct(
            F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"),
            F.struct(url.alias("url")).alias("image_url"))).cast(PART)

    def shape(parts: Column) -> Column:
        all_text = F.forall(parts, lambda p: p["type"] == "text")
        return F.struct(
            F.when(all_text, F.array_join(F.transform(parts, lambda p: p["text"]), "")).alias("text"),
            F.when(~all_text, parts).alias("parts"),
        ).cast(CONTENT)

    plain = F.struct(as_text(content).alias("text"), F.lit(None).cast(f"array<{PART}>").alias("parts")).cast(CONTENT)
    return F.when(_items(content).isNull(), plain).otherwise(
        let(F.filter(F.transform(_items(content), part), lambda p: p.isNotNull()), shape))


def joined_text(content: Column) -> Column:
    """Text of flattened content, text parts on lines of their own."""
    texts = F.filter(F.transform(content["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), lambda t: t != "")
    return F.coalesce(content["text"], F.array_join(texts, "\n"), F.lit(""))


def resolve_max_tokens(request: Column) -> Column:
    candidates = [typed_number(request, f"$.{n}") for n in ("max_output_tokens", "max_completion_tokens", "max_tokens")]
    return F.coalesce(*[F.when(c > 0, c) for c in candidates], F.lit(float(DEFAULT_MAX_TOKENS)))


def translate_tools(request: Column) -> Column:
    """Function tools that have a name, in nested form; null when none is left."""

    def tool(entry: Column) -> Column:
        name = typed_string(entry, "$.name")
        strict = F.try_variant_get(entry, "$.strict", "variant")
        parameters = F.try_variant_get(entry, "$.parameters", "variant")
        body = F.struct(
            name.alias("name"), typed_string(entry, "$.description").alias("description"),
            F.when(F.schema_of_variant(parameters) != "VOID", parameters).alias("parameters"),
            F.when((F.schema_of_variant(strict) == "BOOLEAN") & F.try_variant_get(entry, "$.strict", "boolean"),
                   F.lit(True)).alias("strict"),
        )
        return F.when((typed_string(entry, "$.type") == "function") & (name != ""),
                      F.struct(F.lit("function").alias("type"), body.alias("function")))

    return let(F.filter(F.transform(_items(request, "$.tools"), tool), lambda t: t.isNotNull()),
               lambda tools: F.when(F.size(tools) > 0, tools))


def translate_tool_choice(request: Column) -> Column:
    """Named strategy, or the nested function form as JSON text; ``auto`` and unknown forms give null."""
    text = typed_string(request, "$.tool_choice")
    name = F.when(typed_string(request, "$.tool_choice.type") == "function", F.coalesce(
        typed_string(request, "$.tool_choice.name"), typed_string(request, "$.tool_choice.function.name")))
    nested = F.to_json(F.struct(F.lit("function").alias("type"), F.struct(name.alias("name")).alias("function")))
    return F.when(text != "auto", text).when(text.isNull() & name.isNotNull(), nested)


def _message(role, content: Column, call_id: Column | None = None, calls: Column | None = None) -> Column:
    return F.struct(
        (role if isinstance(role, Column) else F.lit(role)).alias("role"),
        content["text"].alias("text"), content["parts"].alias("parts"),
        (F.lit(None).cast("string") if call_id is None else call_id).alias("tool_call_id"),
        (F.lit(None).cast(f"array<{CALL}>") if calls is None else calls).alias("tool_calls"),
    ).cast(MESSAGE)


def _plain(text: Column) -> Column:
    return F.struct(text.alias("text"), F.lit(None).cast(f"array<{PART}>").alias("parts")).cast(CONTENT)


def _keyed(prefix: str, *parts: Column) -> Column:
    """Stable replacement for a missing id, so that a retried task gives the same one."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32))


def input_messages(request: Column) -> Column:
    """Messages of the request's ``input``; empty ones are left out."""

    def entry_message(entry: Column, i: Column) -> Column:
        kind = typed_string(entry, "$.type")
        role = normalize_role(typed_string(entry, "$.role"))
        content = F.try_variant_get(entry, "$.content", "variant")
        given_id = F.nullif(typed_string(entry, "$.call_id"), F.lit(""))
        call_id = F.coalesce(given_id, _keyed("call_", F.to_json(entry), i.cast("string")))
        call = F.struct(
            call_id.alias("id"), F.lit("function").alias("type"),
            F.struct(F.coalesce(typed_string(entry, "$.name"), F.lit("tool")).alias("name"),
                     as_text(F.try_variant_get(entry, "$.arguments", "variant")).alias("arguments")).alias("function"),
        ).cast(CALL)
        wrapped = F.try_parse_json(F.concat(F.lit("["), F.to_json(entry), F.lit("]")))

        def non_null(v: Column) -> Column:
            return F.when(F.schema_of_variant(v) != "VOID", v)

        rest = F.coalesce(non_null(content), non_null(F.try_variant_get(entry, "$.text", "variant")), entry)
        built = (
            F.when(~_is_object(entry) & _items(entry).isNull(), _message("user", _plain(as_text(entry))))
            .when(role.isNotNull(), _message(role, flatten_content(content)))
            .when(kind == "function_call_output", _message(
                "tool", _plain(as_text(F.try_variant_get(entry, "$.output", "variant"))), call_id))
            .when(kind == "function_call", _message("assistant", _plain(F.lit("")), None, F.array(call)))
            .when(kind.isin("input_text", "input_image"), _message("user", flatten_content(wrapped)))
            .otherwise(_message("user", flatten_content(rest)))
        )
        keep_empty = kind.isin("function_call_output", "function_call") & role.isNull()
        return F.struct(built.alias("m"), F.coalesce(keep_empty, F.lit(False)).alias("keep"))

    given = F.try_variant_get(request, "$.input", "variant")
    single = F.array(F.struct(_message("user", _plain(as_text(given))).alias("m"), F.lit(False).alias("keep")))
    entries = F.coalesce(F.transform(_items(given), entry_message), single)
    kept = F.filter(entries, lambda e: e["keep"] | e["m"]["parts"].isNotNull() | (e["m"]["text"] != ""))
    return F.transform(kept, lambda e: e["m"])


def instruction_messages(request: Column) -> Column:
    text = typed_string(request, "$.instructions")
    return F.when(js_trim(text) != "", F.array(_message("system", _plain(text)))).otherwise(
        F.array().cast(f"array<{MESSAGE}>"))


def merge_system_runs(messages: Column) -> Column:
    """Join neighbouring system messages by a blank line; one with tool fields is not extended."""

    def step(acc: Column, m: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        extend = (m["role"] == "system") & F.coalesce(
            (last["role"] == "system") & last["tool_call_id"].isNull() & last["tool_calls"].isNull(), F.lit(False))
        both = F.filter(F.array(joined_text(last), joined_text(m)), lambda t: t != "")
        merged = _message("system", _plain(F.array_join(both, "\n\n")))
        return F.when(extend, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged))).otherwise(
            F.concat(acc, F.array(m)))

    return F.aggregate(messages, F.array().cast(f"array<{MESSAGE}>"), step)


def to_chat_request(body: Column, history: Column | None = None) -> Column:
    """A logged responses-style request as a chat-completions request. ``history`` are the stored messages of the
    response it continues; instructions count only where there is no history."""

    def build(request: Column) -> Column:
        fresh = input_messages(request)
        if history is None:
            messages = F.concat(instruction_messages(request), fresh)
        else:
            past = F.coalesce(history, F.array().cast(f"array<{MESSAGE}>"))
            messages = F.concat(F.when(F.size(past) > 0, past).otherwise(instruction_messages(request)), fresh)

        def flag(name: str) -> Column:
            inner = F.try_variant_get(request, f"$.{name}", "variant")
            return F.when(F.schema_of_variant(inner) == "BOOLEAN", F.try_variant_get(request, f"$.{name}", "boolean"))

        return F.struct(
            merge_system_runs(messages).alias("messages"), typed_string(request, "$.model").alias("model"),
            resolve_max_tokens(request).alias("max_tokens"),
            F.when(flag("parallel_tool_calls"), F.lit(True)).alias("parallel_tool_calls"),
            flag("stream").alias("stream"), typed_number(request, "$.temperature").alias("temperature"),
            translate_tool_choice(request).alias("tool_choice"), translate_tools(request).alias("tools"),
            typed_number(request, "$.top_p").alias("top_p"), typed_string(request, "$.user").alias("user"),
        )

    return let(F.try_parse_json(body), build)


def _wire_message(m: Column) -> Column:
    """A message in its JSON shape: content is text or a list of parts."""
    content = F.when(m["parts"].isNull(), m["text"].cast("variant")).otherwise(F.to_variant_object(m["parts"]))
    return F.struct(content.alias("content"), m["role"].alias("role"), m["tool_call_id"].alias("tool_call_id"),
                    m["tool_calls"].alias("tool_calls"))


def chat_request_json(request: Column) -> Column:
    """JSON text of a translated request; absent options are left out."""
    choice = request["tool_choice"]
    wire_choice = F.when(F.startswith(choice, F.lit("{")), F.try_parse_json(choice)).otherwise(choice.cast("variant"))
    return F.to_json(F.struct(
        F.transform(request["messages"], _wire_message).alias("messages"), request["model"].alias("model"),
        F.when(request["max_tokens"] == F.floor(request["max_tokens"]),
               request["max_tokens"].cast("long").cast("variant"))
        .otherwise(request["max_tokens"].cast("variant")).alias("max_tokens"),
        *[request[n].alias(n) for n in ("parallel_tool_calls", "stream", "temperature")],
        wire_choice.alias("tool_choice"), *[request[n].alias(n) for n in ("tools", "top_p", "user")],
    ))


def to_response(body: Column, response_id: Column) -> Column:
    """A logged chat completion as a response: items, text, and the assistant message to be stored."""

    def build(payload: Column) -> Column:
        choice = F.get(F.filter(F.coalesce(
            _items(payload, "$.choices"), F.array().cast("array<variant>")), _is_object), 0)
        content = flatten_content(F.try_variant_get(choice, "$.message.content", "variant"))
        calls = F.coalesce(F.filter(F.transform(_items(choice, "$.message.tool_calls"), lambda c, i: F.when(
            typed_string(c, "$.function.name").isNotNull(),
            F.struct(
                F.coalesce(F.nullif(typed_string(c, "$.id"), F.lit("")),
                           _keyed("call_", response_id, i.cast("string"))).alias("id"),
                F.lit("function").alias("type"),
                F.struct(typed_string(c, "$.function.name").alias("name"),
                         as_text(F.try_variant_get(c, "$.function.arguments", "variant")).alias("arguments"))
                .alias("function"),
            ).cast(CALL))), lambda c: c.isNotNull()), F.array().cast(f"array<{CALL}>"))

        def shape(x: Column) -> Column:
            text = F.coalesce(x["content"]["text"], F.array_join(F.filter(F.transform(
                x["content"]["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), lambda t: t != ""), ""), F.lit(""))
            item = "struct<type:string,id:string,text:string,call_id:string,name:string,arguments:string,status:string>"
            message_item = F.struct(
                F.lit("message").alias("type"), _keyed("msg_", response_id).alias("id"), text.alias("text"),
                F.lit(None).alias("call_id"), F.lit(None).alias("name"), F.lit(None).alias("arguments"),
                F.lit("completed").alias("status")).cast(item)
            call_items = F.transform(x["calls"], lambda c: F.struct(
                F.lit("function_call").alias("type"), _keyed("fc_", response_id, c["id"]).alias("id"),
                F.lit(None).alias("text"), c["id"].alias("call_id"), c["function"]["name"].alias("name"),
                c["function"]["arguments"].alias("arguments"), F.lit("completed").alias("status")).cast(item))
            return F.struct(
                response_id.alias("id"), F.lit("response").alias("object"),
                typed_string(payload, "$.model").alias("model"),
                F.concat(F.when(text != "", F.array(message_item)).otherwise(F.array().cast(f"array<{item}>")),
                         call_items).alias("output"),
                F.nullif(text, F.lit("")).alias("output_text"), F.lit("completed").alias("status"),
                _message("assistant", x["content"], None, F.when(F.size(x["calls"]) > 0, x["calls"]))
                .alias("stored_message"),
            )

        return let(F.struct(content.alias("content"), calls.alias("calls")), shape)

    return let(F.try_parse_json(body), build)
