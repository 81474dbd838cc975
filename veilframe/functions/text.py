"""Scalar functions on secrets, tokens, names and times."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import rules


def vault_token(secret: Column, type_: Column, session: Column) -> Column:
    """Placeholder token: type and the first 8 hex digits of a hash over secret and session."""
    digest = F.substring(F.sha2(F.concat(secret, session), 256), 1, 8)
    return F.concat(F.lit(rules.TOKEN_HEAD), type_, F.lit("_"), digest, F.lit("__"))


def record_id(secret: Column) -> Column:
    return F.substring(F.sha2(secret, 256), 1, 12)


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{rules.SPACE}]+|[{rules.SPACE}]+$(?![\s\S])", "")


def preview(secret: Column) -> Column:
    """One-line hint that shows only the ends of a secret."""
    line = F.trim(F.regexp_replace(secret, f"[{rules.SPACE}]+", " "))
    n = F.length(line)
    shown = F.when(n <= 6, 1).when(n <= 12, 2).otherwise(4)
    return F.concat(F.left(line, shown), F.lit("***"), F.right(line, shown))


def redact(secret: Column) -> Column:
    """Form used in log lines."""
    return F.concat(F.left(secret, F.when(F.length(secret) <= 3, 1).otherwise(6)), F.lit("***"))


def strip_tokens(text: Column) -> Column:
    """Remove tokens, then everything from the last unfinished token head on."""
    bare = F.regexp_replace(text, rules.TOKEN_LOOSE, "")
    tail = F.length(F.substring_index(bare, rules.TOKEN_HEAD, -1)) + len(rules.TOKEN_HEAD)
    return F.when(F.contains(bare, F.lit(rules.TOKEN_HEAD)), F.left(bare, F.length(bare) - tail)).otherwise(bare)


def is_token(text: Column) -> Column:
    return F.rlike(text, F.lit(rf"^{rules.TOKEN_LOOSE}\z"))


def unescape_json_text(text: Column) -> Column:
    """Undo JSON string escapes one kind after the other, in this order."""
    for escaped, plain in (("\\r", "\r"), ("\\n", "\n"), ('\\"', '"'), ("\\\\", "\\")):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def unescape_html(text: Column) -> Column:
    """Named and numeric entities of quotes, brackets and ampersand; the ampersand comes last."""
    for entity, plain in (
        ("&quot;", '"'), ("&#34;", '"'), ("&#x22;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"),
        ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
    ):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def relative_age(ts: Column, now: Column) -> Column:
    """Age in the largest whole unit; a time ahead of ``now`` counts as zero."""
    ms = F.greatest(F.unix_millis(now) - F.unix_millis(ts), F.lit(0).cast("long"))

    def unit(size: int, suffix: str) -> Column:
        return F.concat(F.floor(ms / size).cast("string"), F.lit(suffix))

    return (
        F.when(ms < 60_000, "just now")
        .when(ms < 3_600_000, unit(60_000, "m ago"))
        .when(ms < 86_400_000, unit(3_600_000, "h ago"))
        .otherwise(unit(86_400_000, "d ago"))
    )


def normalize_name(name: Column) -> Column:
    return F.nullif(js_trim(name), F.lit(""))


def strip_ansi(text: Column) -> Column:
    """Visible text of terminal output: finished control sequences go, an unfinished escape ends the text."""
    return F.regexp_replace(F.regexp_replace(text, rules.CSI, ""), r"\x1B[\s\S]*$", "")


def register_sql_functions(spark: SparkSession) -> None:
    """The scalars as SQL functions of the session: plain SQL bodies, inlined by Catalyst."""
    def literal(pattern: str) -> str:
        return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"

    ends = literal(rf"^[{rules.SPACE}]+|[{rules.SPACE}]+$(?![\s\S])")
    bodies = {
        "vault_token(secret STRING, type STRING, session STRING)":
            "concat('__VAULT_', type, '_', substr(sha2(concat(secret, session), 256), 1, 8), '__')",
        "record_id(secret STRING)": "substr(sha2(secret, 256), 1, 12)",
        "redact_secret(secret STRING)":
            "concat(left(secret, CASE WHEN length(secret) <= 3 THEN 1 ELSE 6 END), '***')",
        "is_vault_token(value STRING)": f"value RLIKE {literal(rf'^{rules.TOKEN_LOOSE}' + chr(92) + 'z')}",
        "normalize_name(name STRING)": f"nullif(regexp_replace(name, {ends}, ''), '')",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS "
                  f"{'BOOLEAN' if head.startswith('is_') else 'STRING'} RETURN {body}")
