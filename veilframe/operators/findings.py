"""Findings tables: one row per detected secret, and the filters on them."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.config import SECRET_SOURCES, SECRET_TYPES, DetectOptions, check_custom_rules
from veilframe.functions import rules
from veilframe.functions.detect import detect
from veilframe.functions.text import record_id
from veilframe.session import broadcast_if_small


def findings(df: DataFrame, keys: list[str], text: Column | str, options: DetectOptions = DetectOptions()) -> DataFrame:
    """Detect and explode. Narrow: no shuffle, and only the text column leaves the scan besides the keys."""
    check_custom_rules(df.sparkSession, options.custom_rules)
    if isinstance(text, str):
        spans = detect_named(text, options, df.sparkSession.sparkContext.applicationId)
    else:
        spans = detect(text, options)
    return df.select(*keys, F.explode(spans).alias("f")).select(*keys, "f.*")


@lru_cache(maxsize=64)
def detect_named(text: str, options: DetectOptions, application: str) -> Column:
    """The detection expression over a column name. It has some thousand nodes and is built from Python call by call,
    which takes seconds; an unresolved expression fits every table of the application, so it is built once."""
    return detect(F.col(text), options)


def skip_token_values(found: DataFrame) -> DataFrame:
    """A value that begins like a token is no new secret."""
    return found.filter(~F.startswith(F.col("value"), F.lit(rules.TOKEN_HEAD)))


def dry_run(df: DataFrame, keys: list[str], text: str, options: DetectOptions = DetectOptions()) -> DataFrame:
    """Report only: what would be registered, per type, with the text untouched."""
    found = skip_token_values(findings(df, keys, text, options))
    return found.groupBy("type", "confidence").agg(F.count("*").alias("n_findings"))


def check_domain(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Fail the job on a value outside a fixed domain."""
    ok = F.col(column).isin(*domain) | F.col(column).isNull()
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(
        F.raise_error(F.concat(F.lit(f"invalid {column}: "), F.col(column)))))


def check_types(df: DataFrame) -> DataFrame:
    return check_domain(check_domain(df, "type", SECRET_TYPES), "source", SECRET_SOURCES)


def exclude_types(found: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop findings of excluded types; rows registered by hand stay. ``excluded`` has at most one row per type."""
    types = excluded.select("type").filter(F.col("type").isin(*SECRET_TYPES)).distinct()
    return _exclude(found, types, "type")


def exclude_records(found: DataFrame, excluded: DataFrame, value: str = "value") -> DataFrame:
    """Drop findings whose record id is excluded; rows registered by hand stay."""
    ids = excluded.select("record_id").filter(F.col("record_id").isNotNull()).distinct()
    return _exclude(found.withColumn("record_id", record_id(F.col(value))), ids, "record_id").drop("record_id")


def _exclude(found: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    side, _ = broadcast_if_small(excluded, F.length(key))
    by_hand = F.col("source") == "manual" if "source" in found.columns else F.lit(False)
    hit = side.select(F.col(key).alias("_excluded"))
    kept = found.join(hit, (F.col(key) == F.col("_excluded")) & ~F.coalesce(by_hand, F.lit(False)), "left_anti")
    return kept


def add_exclusions(current: DataFrame, added: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Set insert. Record ids count only if the ledger knows them."""
    key = current.columns[0]
    trimmed = added.select(F.trim(key).alias(key))
    if ledger is not None:
        trimmed = trimmed.join(ledger.select(F.col("id").alias(key)), key, "left_semi")
    return current.select(key).union(trimmed).distinct()


def remove_exclusions(current: DataFrame, removed: DataFrame) -> DataFrame:
    key = current.columns[0]
    return current.join(removed.select(F.trim(key).alias(key)), key, "left_anti")
