"""Server-sent event lines: payloads and the text fields in them that may carry tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.spans import let

FIELDS = "array<struct<key:string,value:string>>"


def typed_string(value: Column, path: str = "$") -> Column:
    """The string at ``path`` of a variant; null when it is absent or no string."""
    inner = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(value, path, "string"))


def typed_number(value: Column, path: str) -> Column:
    inner = F.try_variant_get(value, path, "variant")
    kind = F.schema_of_variant(inner)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
    return F.when(number, F.try_variant_get(value, path, "double"))


def sse_data(line: Column) -> Column:
    """Struct of prefix, payload text and parsed payload; lines that carry no JSON object have no parsed payload."""
    prefix = F.when(F.startswith(line, F.lit("data: ")), "data: ").when(F.startswith(line, F.lit("data:")), "data:")
    payload = F.substring(line, F.length(prefix) + 1, F.length(line))
    is_object = F.startswith(F.ltrim(payload), F.lit("{"))
    parsed = F.when(is_object, F.try_parse_json(payload))
    return F.struct(prefix.alias("prefix"), payload.alias("payload"), parsed.alias("json"),
                    F.coalesce(payload == "[DONE]", F.lit(False)).alias("done"))


def _field(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def anthropic_fields(json: Column) -> Column:
    index = F.coalesce(typed_number(json, "$.index").cast("long"), F.lit(0)).cast("string")
    named = [
        _field(F.concat(F.lit("anthropic:"), index, F.lit(f":{name}")), typed_string(json, f"$.{name}"))
        for name in ("delta.text", "delta.partial_json", "content_block.text")
    ]
    named.append(_field(F.lit("anthropic:completion"), typed_string(json, "$.completion")))
    return F.filter(F.array(*named), lambda f: f["value"].isNotNull()).cast(FIELDS)


def openai_fields(json: Column) -> Column:
    choices = F.coalesce(F.try_variant_get(json, "$.choices", "array<variant>"), F.array().cast("array<variant>"))

    def per_choice(choice: Column, position: Column) -> Column:
        index = F.coalesce(typed_number(choice, "$.index").cast("long"), position.cast("long")).cast("string")

        def key(suffix: str) -> Column:
            return F.concat(F.lit("openai:"), index, F.lit(f":{suffix}"))

        simple = F.array(*[
            _field(key(name), typed_string(choice, f"$.{name}"))
            for name in ("text", "delta.content", "delta.function_call.arguments")
        ])
        calls = F.coalesce(
            F.try_variant_get(choice, "$.delta.tool_calls", "array<variant>"), F.array().cast("array<variant>"))
        per_call = F.transform(calls, lambda call, i: _field(
            F.concat(F.lit("openai:"), index, F.lit(":delta.tool_calls."),
                     F.coalesce(typed_number(call, "$.index").cast("int"), i).cast("string"),
                     F.lit(".function.arguments")),
            typed_string(call, "$.function.arguments")))
        return F.concat(simple.cast(FIELDS), per_call.cast(FIELDS))

    return F.filter(F.flatten(F.transform(choices, per_choice)), lambda f: f["value"].isNotNull()).cast(FIELDS)


def sse_text_fields(json: Column, provider: Column) -> Column:
    """Keyed text fields of one event, to be restored key by key over the stream."""
    none = F.array().cast(FIELDS)
    return let(json, lambda j: F.coalesce(
        F.when(provider == "anthropic", anthropic_fields(j)).when(provider == "openai", openai_fields(j)), none))


def json_text(text: Column) -> Column:
    """A text as a JSON string, in quotes."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))
