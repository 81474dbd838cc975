"""Masking: secrets to tokens in text that goes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import vault_token
from veilframe.operators.replace import replace_scoped
from veilframe.operators.vault import replacement_rules

EVERYTHING = "_everything"


def mask_spans(text: Column, found: Column, session: Column, generator=vault_token) -> Column:
    """Rewrite only the detected places, inside the row: no join and no shuffle. Tokens are the base tokens; use it
    with a session per row, or where the vault reported no collision."""

    def piece(f: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.get(found, i - 1)["value_end"])
        return F.concat(F.substring(text, before + 1, f["value_start"] - before), generator(f["value"], f["type"], session))

    last = F.get(found, F.size(found) - 1)["value_end"]
    return F.when(F.size(found) == 0, text).otherwise(
        F.concat(F.array_join(F.transform(found, piece), ""), F.substring(text, last + 1, F.length(text))))


def mask(
    df: DataFrame, vault: DataFrame, scope: list[str], keys: list[str], text: str, out: str,
    count: str | None = None, gate: Column | None = None,
) -> DataFrame:
    """Replace every occurrence of every secret known in the row's scope. ``vault`` carries the scope columns."""
    return replace_scoped(df, replacement_rules(vault, "mask", scope), scope, keys, text, out, count, gate=gate)


def mask_everywhere(
    df: DataFrame, vault: DataFrame, keys: list[str], text: str, out: str, min_secret_length: int,
    count: str | None = None,
) -> DataFrame:
    """One dictionary over all texts. Opt-in: short secrets would rewrite ordinary words, so a least length is named."""
    usable = vault.filter(F.length("secret") >= min_secret_length).withColumn(EVERYTHING, F.lit(0))
    masked = replace_scoped(
        df.withColumn(EVERYTHING, F.lit(0)), replacement_rules(usable, "mask", [EVERYTHING]), [EVERYTHING], keys,
        text, out, count)
    return masked.drop(EVERYTHING)


def mask_as_of(
    df: DataFrame, vault: DataFrame, session: list[str], keys: list[str], order: str, since: str, text: str, out: str,
    count: str | None = None,
) -> DataFrame:
    """Within a session a secret masks only text handled at or after its first registration."""
    rules = vault.filter(F.length("secret") > 0).select(
        *session, F.col("secret").alias("source"), F.col("token").alias("target"), since)
    return replace_scoped(df, rules, session, keys, text, out, count, order=order, since=since)
