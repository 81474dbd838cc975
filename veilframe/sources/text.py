"""Text comes in as (keys, text, source)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.config import SECRET_SOURCES


def scan_text(df: DataFrame, keys: list[str], text: str, source: str) -> DataFrame:
    """Project a table (batch or streaming) to its keys and one text column, tagged with its origin."""
    if source not in SECRET_SOURCES:
        raise ValueError(f"unknown source {source}")
    return df.select(*keys, F.col(text).alias("text"), F.lit(source).alias("source"))


def read_text(spark: SparkSession, path: str, keys: list[str], text: str, source: str) -> DataFrame:
    return scan_text(spark.read.parquet(path), keys, text, source)
