"""Running combinations over an array inside a row, without an accumulator that grows element by element.

A fold that appends to an array copies it at every step. Here whole arrays are combined with themselves, shifted by 1, 2,
4 … places, so that n elements take n times the binary digits of n steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Element i becomes the combination of elements 0 to i. ``combine`` must be associative and keep the type."""
    digits = F.ceil(F.log2(F.size(values))).cast("int")
    shifts = F.transform(F.sequence(F.lit(0), digits - 1), lambda j: F.pow(F.lit(2), j).cast("int"))

    def shifted(now: Column, by: Column) -> Column:
        return F.transform(now, lambda x, i: F.when(i >= by, combine(F.get(now, i - by), x)).otherwise(x))

    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(shifts, values, shifted))


def running_sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    """Nulls are passed over; structs compare field by field."""
    return running(values, lambda a, b: F.greatest(a, b))


PART = 64


def taken_in_order(sorted_spans: Column) -> Column:
    """Of spans (with start and end) sorted by start, each that begins where the last one taken has ended.

    The state is the last end. Places of what is taken are gathered in parts, and parts in parts, so that appending copies little."""
    none, nested = F.array().cast("array<int>"), F.array().cast("array<array<int>>")
    zero = F.struct(F.lit(-1).alias("reach"), none.alias("part"), nested.alias("some"), nested.alias("all"))

    def grown(acc: Column, x: Column, i: Column) -> Column:
        full = F.size(acc["part"]) >= PART
        much = full & (F.size(acc["some"]) >= PART)
        return F.struct(
            x["end"].alias("reach"), F.when(full, F.array(i)).otherwise(F.concat(acc["part"], F.array(i))).alias("part"),
            F.when(much, F.array(acc["part"])).when(full, F.concat(acc["some"], F.array(acc["part"]))).otherwise(acc["some"]).alias("some"),
            F.when(much, F.concat(acc["all"], F.array(F.flatten(acc["some"])))).otherwise(acc["all"]).alias("all"))

    def step(acc: Column, i: Column) -> Column:
        x = F.get(sorted_spans, i)
        return F.when(x["start"] < acc["reach"], acc).otherwise(grown(acc, x, i))

    places = F.aggregate(F.sequence(F.lit(0), F.size(sorted_spans) - 1), zero, step,
                         lambda acc: F.concat(F.flatten(acc["all"]), F.flatten(acc["some"]), acc["part"]))
    return F.when(F.size(sorted_spans) < 2, sorted_spans).otherwise(F.transform(places, lambda i: F.get(sorted_spans, i)))


def clear_of(spans: Column, taken: Column, kind: str) -> Column:
    """The spans that overlap none of ``taken`` (which do not overlap each other), sorted. In order of the spans' ends and the
    taken ones' starts, the furthest end so far says whether a span is met."""
    event = f"array<struct<at:int,turn:int,reach:int,item:{kind}>>"
    events = F.array_sort(F.concat(
        F.transform(spans, lambda s: F.struct(s["end"], F.lit(0), F.lit(None).cast("int"), s)).cast(event),
        F.transform(taken, lambda t: F.struct(t["start"], F.lit(1), t["end"], F.lit(None).cast(kind))).cast(event)))

    def keep(rows: Column) -> Column:
        met = F.zip_with(rows, running_max(F.transform(rows, lambda r: r["reach"])), lambda r, reach: F.when(
            F.coalesce(reach <= r["item"]["start"], F.lit(True)), r["item"]))
        return F.sort_array(F.filter(met, lambda item: item.isNotNull()))

    return let(events, keep)


MARK, PLAIN = "\u0001", "\u0002"


def located(text: Column, regex: str) -> Column:
    """All matches of ``regex``, leftmost and not overlapping: array of (at, value, before, after).

    ``before`` holds up to 40 characters since the match before, ``after`` up to 4 until the next one. Positions are code
    points. Matches are set between marks and the text is split there: one pass of the regex, running sums of the lengths.
    The mark itself (a control character) counts as another control character while this is done.
    """
    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(PLAIN)), F.lit(regex), F.lit(f"{MARK}$0{MARK}"))
    none = F.array().cast("array<struct<at:int,value:string,before:string,after:string>>")

    def place(parts: Column) -> Column:
        sizes = running_sums(F.transform(parts, F.length))
        return let(sizes, lambda ends: F.transform(
            F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)),
            lambda i: F.struct(F.get(ends, i - 1).alias("at"), F.get(parts, i).alias("value"),
                               F.right(F.get(parts, i - 1), F.lit(40)).alias("before"),
                               F.left(F.get(parts, i + 1), F.lit(4)).alias("after"))))

    return let(F.split(marked, MARK, -1), lambda parts: F.when(F.size(parts) < 3, none).otherwise(place(parts)))
