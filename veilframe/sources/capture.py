"""Evidence records of traffic: headers redacted, bodies as JSON where they are JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.http import redact_headers


def json_or_text(body: Column) -> Column:
    """Body as a variant: parsed JSON, the text itself if it is none, null if it is empty."""
    return F.when(body == "", F.lit(None)).otherwise(F.coalesce(F.try_parse_json(body), body.cast("variant")))


def capture_record(request_headers: Column, request_path: Column, request_body: Column, response_headers: Column,
                   response_status: Column, response_body: Column) -> Column:
    return F.to_json(F.struct(
        redact_headers(request_headers).alias("client_headers"), request_path.alias("client_path"),
        json_or_text(request_body).alias("client_request_body"), json_or_text(response_body).alias("response_body"),
        redact_headers(response_headers).alias("response_headers"), response_status.alias("response_status_code"),
    ))


def write_capture(df: DataFrame, path: str, record: str, partition: str) -> None:
    """One JSON record per line, in a folder per ``partition`` value."""
    df.select(F.col(record).alias("value"), partition).write.mode("append").partitionBy(partition).text(path)
