"""Named queries with their SQL counterparts, and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SESSION = "session-1"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as its files give it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(moment):
    """A zone-less timestamp read as UTC, whatever the session's time zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", start, moment.cast("timestamp_ntz")))


def digest(spark_side: bool, label: str, length: int, id_: str) -> str:
    """Hex digits derived from a table key, in either dialect."""
    seed = f"'{label}' || cast({id_} as string)"
    whole = f"sha2({seed}, 256)" if spark_side else f"sha256({seed})"
    return f"substr({whole}, 1, {length})"


class Injected:
    """A text column built from table keys by one expression that both engines run: ``{label:length}`` stands for hex
    digits derived from the key, ``{label:length:U}`` for upper case, ``{nl}`` for a line break."""

    def __init__(self, template: str, id_: str) -> None:
        self.template, self.id = template, id_

    def expression(self, spark_side: bool) -> str:
        parts = []
        rest = self.template
        while rest:
            before, brace, after = rest.partition("{")
            if before:
                literal = before.replace("'", "''") if not spark_side else before.replace("\\", "\\\\").replace("'", "\\'")
                parts.append(f"'{literal}'")
            if not brace:
                break
            field, _, rest = after.partition("}")
            bits = field.split(":")
            if bits[0] == "nl":
                parts.append("chr(10)")
            elif bits[0] == "esc":
                parts.append("chr(27)")
            elif bits[0] == "col":
                parts.append(bits[1])
            else:
                made = digest(spark_side, bits[0], int(bits[1]), self.id)
                parts.append(f"upper({made})" if bits[2:] == ["U"] else made)
        return " || ".join(parts)

    @property
    def spark(self):
        return F.expr(self.expression(True))

    @property
    def sql(self) -> str:
        return f"({self.expression(False)})"
