"""The audit ledger: what was seen, when, how often; and job statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.config import RECENT_LIMIT
from veilframe.functions.text import preview, record_id

LEDGER_COLUMNS = ["id", "created_at", "last_seen_at", "name", "preview", "seen_count", "source", "type"]
LEDGER_SCHEMA = (
    "id string, created_at timestamp, last_seen_at timestamp, name string, preview string, seen_count bigint, "
    "source string, type string"
)


def audit_ledger(events: DataFrame) -> DataFrame:
    """One record per secret from registration events (secret, type, source, seen_at, name, ord)."""
    return events.groupBy("secret").agg(
        F.min_by("seen_at", "ord").alias("created_at"), F.max_by("seen_at", "ord").alias("last_seen_at"),
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("ord"))).alias("name"),
        F.count("*").alias("seen_count"), F.max_by("source", "ord").alias("source"),
        F.max_by("type", "ord").alias("type"),
    ).select(
        record_id(F.col("secret")).alias("id"), "created_at", "last_seen_at", "name",
        preview(F.col("secret")).alias("preview"), "seen_count", "source", "type")


def merge_ledgers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Continue a stored ledger with the records of a later run."""
    both = old.withColumn("_run", F.lit(0)).unionByName(new.withColumn("_run", F.lit(1)))
    return both.groupBy("id").agg(
        F.min("created_at").alias("created_at"), F.max("last_seen_at").alias("last_seen_at"),
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("_run"))).alias("name"),
        F.max_by("preview", "_run").alias("preview"), F.sum("seen_count").alias("seen_count"),
        F.max_by("source", "_run").alias("source"), F.max_by("type", "_run").alias("type"),
    ).select(*LEDGER_COLUMNS)


def recent(ledger: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    """The records seen last; at least one. Taken at read time, so counts of older records are not lost."""
    return ledger.orderBy(F.col("last_seen_at").desc(), "id").limit(max(1, limit))


def job_stats(handled: DataFrame, text: str, masked: str, vault: DataFrame, first_seen: DataFrame,
              restored: Column | None = None) -> DataFrame:
    """Counters of one run: new secrets, changed inputs, vault size, restored tokens."""
    inputs = handled.agg(
        F.count_if(F.col(masked) != F.col(text)).alias("masked_inputs"),
        F.coalesce(F.sum(restored) if restored is not None else F.lit(0), F.lit(0)).cast("long").alias("restored_outputs"),
    )
    size = vault.agg(F.count("*").alias("registered_secrets"))
    seen = first_seen.agg(F.count("*").alias("detected_secrets"))
    names = ["masked_inputs", "restored_outputs", "registered_secrets", "detected_secrets"]
    rows = inputs.unionByName(size, allowMissingColumns=True).unionByName(seen, allowMissingColumns=True)
    return rows.agg(*[F.max(n).alias(n) for n in names])
