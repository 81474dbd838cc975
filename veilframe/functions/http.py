"""Predicates and projections on logged HTTP headers (map of name to list of values) and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
HOP_HEADERS = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade",
)
SENSITIVE_HEADERS = ("authorization", "cookie", "proxy-authorization", "set-cookie", "x-api-key")
TEXT_MARKS = ("application/json", "+json", "application/x-ndjson")
ANTHROPIC_PATHS = ("/v1/messages", "/v1/complete")
OPENAI_PATHS = (
    "/v1/chat/", "/v1/completions", "/v1/responses", "/responses", "/v1/embeddings", "/v1/audio",
)
# ----------------------------------------------------------------------------------------------------------------


def first_header(headers: Column, name: str) -> Column:
    """First value of the header ``name`` (given in lower case), however the log spells the name."""
    return F.get(F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name)), 0), 0)


def redact_headers(headers: Column) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(
        F.lower(k).isin(*SENSITIVE_HEADERS), F.array(F.lit("<redacted>"))).otherwise(v))


def drop_hop_headers(headers: Column, keep_upgrade: bool = False) -> Column:
    """Headers that may travel on; an upgrade request keeps the two that ask for it."""
    dropped = [h for h in HOP_HEADERS if not (keep_upgrade and h in ("connection", "upgrade"))]
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*dropped))


def is_text_content(headers: Column) -> Column:
    kind = F.coalesce(F.lower(first_header(headers, "content-type")), F.lit(""))
    marks = reduce(lambda a, b: a | b, [F.contains(kind, F.lit(m)) for m in TEXT_MARKS])
    return (kind == "") | F.startswith(kind, F.lit("text/")) | marks


def is_sse(headers: Column) -> Column:
    kind = F.coalesce(F.lower(first_header(headers, "content-type")), F.lit(""))
    return F.contains(kind, F.lit("text/event-stream"))


def route_provider(path: Column, headers: Column, default: str | None = None) -> Column:
    """Struct of provider, path behind a provider prefix, and an error where no rule applies."""
    given = F.coalesce(path, F.lit(""))
    p = F.when(F.startswith(given, F.lit("/")), given).otherwise(F.concat(F.lit("/"), given))
    low = F.lower(p)

    def prefixed(name: str) -> Column:
        return (p == f"/{name}") | F.startswith(p, F.lit(f"/{name}/"))

    def rest(name: str) -> Column:
        return F.when(p == f"/{name}", "/").otherwise(F.substring(p, F.lit(len(name) + 2), F.length(p)))

    def present(*names: str) -> Column:
        return reduce(lambda a, b: a | b, [first_header(headers, n).isNotNull() for n in names])

    def family(paths: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, [F.startswith(low, F.lit(x)) for x in paths])

    provider = (
        F.when(p == "/health", F.lit(None).cast("string"))
        .when(prefixed("anthropic"), "anthropic")
        .when(prefixed("openai"), "openai")
        .when(present("anthropic-version", "x-api-key"), "anthropic")
        .when(present("authorization", "openai-organization", "openai-beta"), "openai")
        .when(family(ANTHROPIC_PATHS), "anthropic")
        .when(family(OPENAI_PATHS), "openai")
        .otherwise(F.lit(default).cast("string"))
    )
    upstream = F.when(prefixed("anthropic"), rest("anthropic")).when(prefixed("openai"), rest("openai")).otherwise(p)
    error = F.when(p == "/health", "health request").when(provider.isNull(), "unresolved provider")
    return F.struct(provider.alias("provider"), upstream.alias("upstream_path"), error.alias("error"))
