"""Per-session order of text: first sightings and the rolling detection window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.config import DETECTION_WINDOW, DetectOptions
from veilframe.functions.text import strip_tokens
from veilframe.operators.findings import findings, skip_token_values
from veilframe.operators.ordered import rolling_text


def first_sightings(found: DataFrame, session: list[str], order: list[str]) -> DataFrame:
    """First place of every secret in its session. Aggregated before the shuffle, however often a secret occurs."""
    place = F.struct(*order)
    firsts = found.groupBy(*session, "value").agg(F.min_by(F.struct("type", *order), place).alias("f"))
    return firsts.select(*session, "value", F.col("f.type").alias("type"), *[F.col(f"f.{c}").alias(c) for c in order])


def flag_new(found: DataFrame, session: list[str], order: list[str]) -> DataFrame:
    """Add ``is_new``: the finding is the first of its secret in the session. ``order`` identifies a finding in it."""
    firsts = first_sightings(found, session, order).select(*session, "value", *order, F.lit(True).alias("is_new"))
    return found.join(firsts, [*session, "value", *order], "left").withColumn(
        "is_new", F.coalesce("is_new", F.lit(False)))


def window_text(df: DataFrame, session: list[str], order: str, text: str, window: int = DETECTION_WINDOW) -> DataFrame:
    """The session's last characters at every turn, tokens left out: what a secret split over turns is looked for in.

    Tokens are taken to be whole within a turn; the streaming detector also handles tokens split over chunks.
    """
    return rolling_text(df, session, order, strip_tokens(F.col(text)), "window_text", window)


def window_findings(
    df: DataFrame, session: list[str], order: str, text: str, options: DetectOptions = DetectOptions(),
    window: int = DETECTION_WINDOW,
) -> DataFrame:
    rolled = window_text(df, session, order, text, window)
    return skip_token_values(findings(rolled, [*session, order], "window_text", options))
