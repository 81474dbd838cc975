"""End-to-end jobs: mask a corpus, mask and restore traffic, register by hand."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.config import DetectOptions
from veilframe.functions.detect import infer_type, may_hold_secret
from veilframe.functions.http import is_sse, is_text_content, route_provider
from veilframe.functions.sse import json_text
from veilframe.functions.text import strip_tokens, unescape_json_text, vault_token
from veilframe.operators.audit import audit_ledger
from veilframe.operators.findings import (
    detect_named, exclude_records, exclude_types, findings, skip_token_values,
)
from veilframe.operators.mask import mask, mask_as_of, mask_spans
from veilframe.operators.replace import join_null_safe, occurring_sources
from veilframe.operators.restore import restore
from veilframe.operators.vault import build_vault, rehydrate_vault, require_unique_names, sightings
from veilframe.session import cut_lineage, spread
from veilframe.streaming.cutters import TokenHold
from veilframe.streaming.events import body_cells


@dataclass
class Masked:
    texts: DataFrame
    vault: DataFrame
    ledger: DataFrame
    findings: DataFrame


def mask_corpus(
    df: DataFrame, keys: list[str], text: str, session: str, seen_at: Column, source: str = "stdin",
    options: DetectOptions = DetectOptions(), excluded: DataFrame | None = None, scope: list[str] | None = None,
    count: str = "n_masked",
) -> Masked:
    """Detect, register, mask, audit.

    The findings are written once (they are small against the text); the vault and the ledger come from them. Texts
    are then read a second time and meet only the vault rows of their own scope, by default the row itself. Rows that
    cannot hold a secret skip that join, so the bulk of the text is never shuffled.
    """
    scope = scope or keys
    found = skip_token_values(findings(df, keys, text, options)).withColumn("source", F.lit(source))
    if excluded is not None:
        found = exclude_records(exclude_types(found, excluded.filter("type is not null")), excluded)
    found = cut_lineage(found)
    events = sightings(found.withColumn("_seen", seen_at), source, F.col("_seen"), [*keys, "start"])
    vault = cut_lineage(build_vault(events, session))
    scoped = found.select(*scope, F.col("value").alias("secret")).distinct().join(vault, "secret")
    scoped = cut_lineage(scoped.select(*scope, "secret", "token"))
    gate = may_hold_secret(F.col(text), options) if scope == keys else None
    texts = mask(df, scoped, scope, keys, text, "masked_text", count, gate=gate)
    return Masked(texts, vault, audit_ledger(events), found)


def mask_rows(df: DataFrame, keys: list[str], text: str, out: str, session: Column,
              options: DetectOptions = DetectOptions()) -> DataFrame:
    """Detect and rewrite in one narrow pass: one scan, no shuffle. Every row is a session of its own, so two rows
    give the same secret different tokens."""
    spans = detect_named(text, options, df.sparkSession.sparkContext.applicationId)
    found = F.filter(spans, lambda f: ~F.startswith(f["value"], F.lit("__VAULT_")))
    staged = df.withColumn("_found", found)
    return staged.select(
        *df.columns, mask_spans(F.col(text), F.col("_found"), session, vault_token).alias(out),
        F.size("_found").alias("n_findings"))


def inspected_body(body: Column) -> Column:
    """What detection sees of a request body: JSON escapes undone, tokens left out."""
    return strip_tokens(unescape_json_text(body))


def mask_traffic(log: DataFrame, keys: list[str], session: str, seen_at: Column,
                 options: DetectOptions = DetectOptions(), default_provider: str | None = None,
                 observation: Observation | None = None, scope: list[str] | None = None, order: str | None = None,
                 known_vault: DataFrame | None = None, excluded: DataFrame | None = None) -> Masked:
    """Route logged requests; mask the bodies that are text, leave the others as they are. ``observation`` receives the
    number and the characters of the inspected bodies while the job runs.

    With ``scope`` (the columns of a session) and ``order`` (a request's place in it), a request is masked by all its session
    knows by then: what was found in it or in earlier requests, and the stored secrets of ``known_vault``, which every
    session knows from its start. Without them a request is masked by what was found in itself and by the stored
    secrets. ``excluded`` (record_id, type) names what is neither detected nor taken from the stored vault.
    """
    if (scope is None) != (order is None):
        raise ValueError("a session needs both its columns and the place of a request in it")
    routed = log.withColumn("route", route_provider(F.col("path"), F.col("headers"), default_provider)).withColumn(
        "is_text", is_text_content(F.col("headers")) & (F.length("body") > 0) & F.col("route.error").isNull())
    text_rows = routed.filter("is_text").withColumn("_seen_body", inspected_body(F.col("body")))
    if observation is not None:
        text_rows = text_rows.observe(
            observation, F.count("*").alias("n_bodies"), F.sum(F.length("body").cast("long")).alias("n_characters"))
    row = list(dict.fromkeys([*keys, *(scope or []), *([order] if order else [])]))
    found = skip_token_values(findings(text_rows, row, "_seen_body", options)).withColumn("source", F.lit("proxy"))
    if excluded is not None:
        found = exclude_records(exclude_types(found, excluded.filter("type is not null")), excluded)
    found = cut_lineage(found)
    events = sightings(found.withColumn("_seen", seen_at), "proxy", F.col("_seen"), [*keys, "start"])
    asked = found.select(*row, F.col("value").alias("secret"))
    if known_vault is None:
        vault = cut_lineage(build_vault(events, session))
    else:
        none = log.sparkSession.createDataFrame([], "record_id string, type string")
        skipped = excluded if excluded is not None else none
        vault = cut_lineage(rehydrate_vault(
            known_vault, events, session, skipped.filter("type is not null").select("type"),
            skipped.filter("record_id is not null").select("record_id")))
        stored = known_vault.select("secret").filter(F.length("secret") > 0).select(F.col("secret").alias("source"))
        hits = occurring_sources(text_rows, cut_lineage(stored.distinct()), row, "body")
        asked = asked.union(hits.select(*row, F.col("source").alias("secret")))
    bodies, where = routed.filter("is_text"), scope or keys
    first = [F.min(order).alias("_since")] if order else []
    scoped = asked.groupBy(*where, "secret").agg(*first, F.count("*").alias("_n")).drop("_n")
    scoped = cut_lineage(scoped.join(vault.select("secret", "token"), "secret"))
    # Only a body in which something may be found by itself passes the gate; what a session or a vault knows may be anywhere.
    gate = may_hold_secret(inspected_body(F.col("body")), options) if scope is None and known_vault is None else None
    if order:
        masked = mask_as_of(bodies, scoped, scope, keys, order, "_since", "body", "masked_body", "n_masked")
    else:
        masked = mask(bodies, scoped, keys, keys, "body", "masked_body", "n_masked", gate=gate)
    plain = routed.filter("not coalesce(is_text, false)").withColumn("masked_body", F.col("body")).withColumn(
        "n_masked", F.lit(0))
    return Masked(masked.unionByName(plain), vault, audit_ledger(events), found)


def register_by_hand(entries: DataFrame, session: str, seen_at: Column, order: list[str],
                     options: DetectOptions = DetectOptions()) -> DataFrame:
    """Vault of (name, secret) rows entered by hand; the type comes from the secret or from its name."""
    typed = entries.withColumn("type", infer_type(F.col("name"), F.col("secret"), options.custom_rules))
    events = sightings(typed.withColumn("value", F.col("secret")).withColumn("_seen", seen_at), "manual",
                       F.col("_seen"), order, F.col("name"))
    return require_unique_names(build_vault(events, session))


BODY_BYTES = 4 << 20  # of logged bodies that a worker takes at once
CELL_ROWS = 1 << 14  # of cells that it gives back at once


def _event_cells(events: DataFrame, keys: list[str]) -> DataFrame:
    """Event-stream bodies taken apart: (keys, line, at, parts, pieces). Cells are many times a body's size, so bodies come in
    batches of some megabytes, whatever their number, and cells leave as they are made."""
    events.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BODY_BYTES)
    schema = T.StructType([*[events.schema[k] for k in keys], *T._parse_datatype_string("line int, at int, parts string, pieces string").fields])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = TokenHold()
        for batch in batches:
            names = [batch.column(k) for k in keys]

            def made(rows: list[tuple]) -> pa.RecordBatch:
                row, *rest = zip(*rows)
                columns = [*(name.take(pa.array(row, pa.int64())) for name in names),
                           *(pa.array(c, t) for c, t in zip(rest, (pa.int32(), pa.int32(), pa.string(), pa.string())))]
                return pa.RecordBatch.from_arrays(columns, schema.names)

            rows: list[tuple] = []
            for i in range(batch.num_rows):
                provider, body = (batch.column(c)[i].as_py() for c in ("provider", "body"))
                for line, cell in enumerate(body_cells(provider or "", body, cutter)):
                    rows += [(i, line, at, part, piece) for at, (part, piece) in enumerate(zip_longest(*cell))]
                    if len(rows) >= CELL_ROWS:
                        yield made(rows)
                        rows = []
            if rows:
                yield made(rows)

    return spread(events.select(*keys, "provider", "body"), *keys).mapInArrow(cells, schema)


def routed_responses(requests: DataFrame, responses: DataFrame, keys: list[str], default_provider: str | None = None) -> DataFrame:
    """Each response with the provider that its request was routed to. A response without a logged request has none."""
    asked = requests.select(*keys, route_provider(F.col("path"), F.col("headers"), default_provider)["provider"].alias("provider"))
    return join_null_safe(responses, asked, keys, "left")


def restore_responses(routed: DataFrame, vault: DataFrame, keys: list[str]) -> DataFrame:
    """The response side of a traffic log: ``body`` restored into ``restored_body``, with ``form`` (events, text or other).

    ``keys`` identify an exchange. Event streams are restored in the text fields of their events, also where a token is torn
    over events, and written back as lines; other text is restored as a whole; everything else stays as it is. In an event
    stream of no known provider no field carries tokens, so it stays as well.
    """
    text = F.coalesce(F.length("body") > 0, F.lit(False))
    form = F.when(text & is_sse(F.col("headers")), "events").when(text & is_text_content(F.col("headers")), "text").otherwise("other")
    formed = cut_lineage(routed.withColumn("form", form))
    columns = [*routed.columns, "form"]
    plain = formed.where("form = 'other'").withColumn("restored_body", F.col("body"))
    whole = restore(formed.where("form = 'text'"), vault, keys, "body", "restored_body")
    # Only streams in which a token may be torn or whole are taken apart.
    events = formed.where("form = 'events'")
    lines = cut_lineage(_event_cells(events, keys))
    cells = restore(lines, vault, [*keys, "line", "at"], "pieces", "restored")
    text = F.concat("parts", F.coalesce(json_text(F.col("restored")), F.lit("")))
    bodies = cells.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "at", text.alias("t")))), lambda c: c["t"]), "")
                                      .alias("restored_body"))
    return join_null_safe(events, bodies, keys, "left").select(*columns, "restored_body").unionByName(
        whole.select(*columns, "restored_body")).unionByName(plain)


def restore_traffic(requests: DataFrame, responses: DataFrame, vault: DataFrame, keys: list[str], default_provider: str | None = None) -> DataFrame:
    """Responses of a traffic log, restored: requests (keys, path, headers) and responses (keys, headers, body) of an exchange are
    joined, then ``restore_responses``."""
    return restore_responses(routed_responses(requests, responses, keys, default_provider), vault, keys)
