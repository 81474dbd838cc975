"""Tokens back to secrets. Tokens have a grammar, so a text names the vault rows it needs: an equi-join does the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.config import SECRET_TYPES
from veilframe.functions import rules
from veilframe.functions.text import strip_ansi
from veilframe.operators.replace import count_matches, join_null_safe, replace_with_pairs
from veilframe.session import BROADCAST_LIMIT_BYTES


def tokens_in(text: Column, regex: str = rules.TOKEN_CLOSED) -> Column:
    """Every place a token can be read, also where two share their underscores."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({regex}))"), F.lit(1)))


def restore(
    df: DataFrame, vault: DataFrame, keys: list[str], text: str, out: str, count: str | None = None,
    scope: list[str] | None = None, token_regex: str = rules.TOKEN_CLOSED,
) -> DataFrame:
    """Replace known tokens by their secrets; unknown ones stay. ``keys`` identify a row.

    Rows without a token head never leave their partition. Of the others only the distinct tokens are shuffled.
    """
    return _restore(df, vault, keys, text, out, count, scope or [], F.contains(F.col(text), F.lit(rules.TOKEN_HEAD)),
                    F.col(text), token_regex, lambda raw: raw)


ANSI_GAP = rf"(?:{rules.CSI})*"


def _spelled(word: str) -> str:
    return ANSI_GAP.join(word)


def _ansi_token_regex() -> str:
    types = "|".join(_spelled(t) for t in SECRET_TYPES)
    hexes = ANSI_GAP.join(["[0-9a-f]"] * 8) + f"(?:{ANSI_GAP}[0-9a-f])?"
    return ANSI_GAP.join([_spelled("__VAULT_"), f"(?:{types})", "_", hexes, _spelled("__")])


def restore_ansi(
    df: DataFrame, vault: DataFrame, keys: list[str], text: str, out: str, count: str | None = None,
    scope: list[str] | None = None,
) -> DataFrame:
    """As ``restore`` on the visible text of terminal output: escapes inside a restored token go with it, all others
    stay. Behind an escape that is no finished control sequence nothing is restored."""
    broken = F.regexp_instr(F.col(text), F.lit(r"\x1B(?!\[[^@-~]*[@-~])"))
    head = F.when(broken > 0, F.left(F.col(text), broken - 1)).otherwise(F.col(text))
    maybe = F.contains(strip_ansi(F.col(text)), F.lit(rules.TOKEN_HEAD))
    return _restore(df, vault, keys, text, out, count, scope or [], maybe, head, _ansi_token_regex(), strip_ansi)


def _restore(df, vault, keys, text, out, count, scope, maybe, head, regex, visible) -> DataFrame:
    hit = F.coalesce(maybe, F.lit(False))
    plain = df.filter(~hit).withColumn(out, F.col(text))
    plain = plain.withColumn(count, F.lit(0)) if count else plain
    touched = df.filter(hit)
    row = list(dict.fromkeys([*keys, *scope]))
    asked = touched.select(*row, F.explode(tokens_in(head, regex)).alias("source"))
    asked = asked.withColumn("token", visible(F.col("source")))
    # Of entries that share a token the first secret in text order counts.
    known = vault.groupBy(*scope, "token").agg(F.min("secret").alias("target"))
    size = vault.agg(F.sum((F.length("token") + F.length("secret")).cast("long") + 64).alias("b")).first()["b"] or 0
    if size <= BROADCAST_LIMIT_BYTES:
        known = F.broadcast(known)
    pairs = join_null_safe(asked, known, [*scope, "token"], "inner").groupBy(*keys).agg(
        F.collect_set(F.struct("source", "target")).alias("_pairs"))
    joined = join_null_safe(touched, pairs, keys, "left")
    tail = F.substring(F.col(text), F.length(head) + 1, F.length(text))
    columns = [*df.columns, F.concat(replace_with_pairs(head, F.col("_pairs")), tail).alias(out)]
    if count:
        columns.append(count_matches(head, F.col("_pairs")).alias(count))
    return joined.select(*columns).unionByName(plain)
