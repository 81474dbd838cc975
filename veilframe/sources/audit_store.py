"""The audit ledger and the exclusion lists as JSON tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.text import normalize_name
from veilframe.operators.audit import LEDGER_SCHEMA
from veilframe.operators.findings import check_types


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Typed read: a malformed record, an unknown type or source, or a missing field fails the job."""
    raw = spark.read.schema(LEDGER_SCHEMA).option("mode", "FAILFAST").json(path)
    for column in ("created_at", "last_seen_at", "preview", "seen_count", "source", "type"):
        raw = raw.withColumn(column, F.coalesce(F.col(column), F.raise_error(F.lit(f"audit record without {column}"))))
    return check_types(raw).withColumn("name", normalize_name(F.col("name"))).withColumn(
        "id", F.trim("id")).filter("id <> ''")


def write_audit(ledger: DataFrame, path: str) -> bool:
    """Replace the stored ledger; an empty result leaves the stored one alone."""
    if ledger.isEmpty():
        return False
    ledger.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    return True


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Excluded record ids and types; ids are trimmed, empty ones dropped."""
    raw = spark.read.schema("record_id string, type string").option("mode", "FAILFAST").json(path)
    return raw.withColumn("record_id", F.nullif(F.trim("record_id"), F.lit(""))).filter(
        "record_id is not null or type is not null")
