"""Ordered per-key state without a per-key task.

A window over one key runs in one task, however long the key's history is. Here a key is cut into blocks of its order
column; windows run inside blocks, and what a block inherits from the blocks before it comes from one row per block.
The order column is an integer, unique within a key, so a block never holds more than ``span`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SPAN = 50_000
SEGMENT_ROWS = 4096


def running(
    df: DataFrame, keys: list[str], order: str, sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None, span: int = BLOCK_SPAN,
) -> DataFrame:
    """Add, for every row, values over the *earlier* rows of its key: sums, and last non-null values."""
    sums, lasts = sums or {}, lasts or {}
    keyed = df.withColumn("_block", F.col(order) - F.pmod(F.col(order), F.lit(span)))
    by_block = [*keys, "_block"]
    earlier = Window.partitionBy(*by_block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.select(
        "*",
        *[F.sum(e).over(earlier).alias(f"_in_{n}") for n, e in sums.items()],
        *[F.last(e, ignorenulls=True).over(earlier).alias(f"_in_{n}") for n, e in lasts.items()],
    )
    totals = keyed.groupBy(*by_block).agg(
        *[F.sum(e).alias(n) for n, e in sums.items()],
        *[F.max_by(e, F.when(e.isNotNull(), F.col(order))).alias(n) for n, e in lasts.items()],
    )
    blocks_before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in by_block],
        *[F.sum(n).over(blocks_before).alias(f"_before_{n}") for n in sums],
        *[F.last(n, ignorenulls=True).over(blocks_before).alias(f"_before_{n}") for n in lasts],
    )
    match = F.lit(True)
    for c in by_block:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = local.join(carry, match, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.coalesce(F.col(f"_in_{n}"), F.lit(0)) + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n)
          for n in sums],
        *[F.coalesce(F.col(f"_in_{n}"), F.col(f"_before_{n}")).alias(n) for n in lasts],
    )


def numbered(df: DataFrame, keys: list[str], order: str, name: str = "row_index", span: int = BLOCK_SPAN) -> DataFrame:
    """0-based position of every row within its key."""
    return running(df, keys, order, sums={name: F.lit(1).cast("long")}, span=span)


def lagged(df: DataFrame, keys: list[str], order: str, value: Column, name: str, span: int = BLOCK_SPAN) -> DataFrame:
    """Value of the previous row of the key; null for the first one."""
    boxed = running(df, keys, order, lasts={name: F.struct(value.alias("v"))}, span=span)
    return boxed.withColumn(name, F.col(name)["v"])


def rolling_text(
    df: DataFrame, keys: list[str], order: str, text: Column, name: str, window: int,
    bucket: int | None = None, span: int = BLOCK_SPAN,
) -> DataFrame:
    """Last ``window`` characters of the key's text up to and including each row.

    Rows are placed by the running length of the text. A row is needed by itself and by rows that end less than
    ``window`` characters later, so every bucket of text gets a copy of the rows just before it and a window over a
    bucket sees at most ``bucket + window`` characters, besides the longest single text.
    """
    bucket = bucket or 16 * window
    sized = running(df.withColumn("_piece", F.coalesce(text, F.lit(""))), keys, order,
                    sums={"_before": F.length("_piece").cast("long")}, span=span)
    placed = sized.withColumn("_end", F.col("_before") + F.length("_piece"))
    home = F.floor(F.col("_end") / bucket)
    last = F.when(F.col("_piece") != "", F.floor((F.col("_end") + window - 1) / bucket)).otherwise(home)
    spread = placed.withColumn("_home", home).withColumn("_bucket", F.explode(F.sequence(home, last)))
    reach = Window.partitionBy(*keys, "_bucket").orderBy("_end").rangeBetween(-(window - 1), Window.currentRow)
    pieces = F.collect_list(F.when(F.col("_piece") != "", F.struct("_end", "_piece"))).over(reach)
    text_so_far = F.array_join(F.transform(F.sort_array(pieces), lambda p: p["_piece"]), "")
    return (
        spread.withColumn(name, F.right(text_so_far, F.lit(window)))
        .filter(F.col("_bucket") == F.col("_home"))
        .select(*df.columns, name)
    )
