"""Located regex matches and span algebra as Catalyst expressions. Positions are 0-based code points, half open."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.scans import clear_of, let, running_sums, taken_in_order

# Field order is the sort order: stage, then position, then rule order.
CANDIDATE = (
    "struct<stage:int,start:int,end:int,ord:int,value:string,type:string,confidence:string,"
    "pattern_id:string,value_start:int,value_end:int>"
)
NO_CANDIDATES = f"array<{CANDIDATE}>"


def no_candidates() -> Column:
    return F.array().cast(NO_CANDIDATES)


MARK, PART = "\u0001", "\u0002"


def gaps_between(text: Column, rx: Column) -> Column:
    """Texts between the matches. ``split`` compiles its regex anew for every row, the replacing function once per
    task: so matches are replaced by a mark, and the mark is split at. A text that holds the mark is split directly."""
    marked = F.split(F.regexp_replace(text, rx, F.lit(MARK)), F.lit(MARK), -1)
    return F.when(F.contains(text, F.lit(MARK)), F.split(text, rx, -1)).otherwise(marked)


def located_matches(text: Column, regex: Column | str, groups: int) -> Column:
    """All non-overlapping matches, left to right: array of (at, full, g1..gN).

    One pass of the regex sets every match and its groups between marks; the text is split there, and running sums over
    the lengths of gaps and matches give every position. A text that holds a mark itself is searched once for the gaps and
    once for each group; a zero-width match at its very start may have no gap of its own and is then left out.
    """
    rx = F.lit(regex) if isinstance(regex, str) else regex
    names = [f"g{i}" for i in range(1, groups + 1)]
    hit_type = "struct<at:int,full:string" + "".join(f",{n}:string" for n in names) + ">"
    none = F.array().cast(f"array<{hit_type}>")

    def placed(hits: Column, widths: Column, field: Callable[[Column, int], Column]) -> Column:
        """Hits with the places that the widths of gap and match add up to."""
        return let(running_sums(widths), lambda ends: F.zip_with(hits, ends, lambda h, end: F.struct(
            (end - F.length(field(h, 0))).alias("at"), field(h, 0).alias("full"),
            *[field(h, i + 1).alias(n) for i, n in enumerate(names)])))

    def read(parts: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), lambda i: F.split(F.get(parts, i), F.lit(PART), -1))
        found = let(cut, lambda hits: placed(hits, F.transform(
            hits, lambda h, i: F.length(F.get(parts, 2 * i)) + F.length(F.get(h, F.lit(0)))), lambda h, i: F.get(h, F.lit(i))))
        return F.when(F.size(parts) < 3, none).otherwise(found)

    def search(fulls: Column) -> Column:
        fields = F.struct(
            gaps_between(text, rx).alias("gap"), fulls.alias("full"),
            *[F.regexp_extract_all(text, rx, F.lit(i + 1)).alias(n) for i, n in enumerate(names)],
        )

        def place(m: Column) -> Column:
            n = F.size(m["full"])
            skip = n + 1 - F.size(m["gap"])
            hits = F.slice(F.arrays_zip(m["full"], *[m[c] for c in names]), skip + 1, n - skip)
            widths = F.transform(F.sequence(F.lit(0), n - 1 - skip), lambda i: F.length(F.get(m["gap"], i)) + F.length(F.get(m["full"], i + skip)))
            return F.when(skip == n, none).otherwise(placed(hits, widths, lambda h, i: h[["full", *names][i]]))

        return F.when(F.size(fulls) == 0, none).otherwise(let(fields, place))

    groups_out = "".join(f"{PART}${i}" for i in range(1, groups + 1))
    marked = F.split(F.regexp_replace(text, rx, F.lit(f"{MARK}$0{groups_out}{MARK}")), F.lit(MARK), -1)
    return F.when(F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(PART)), let(F.regexp_extract_all(text, rx, F.lit(0)), search)).otherwise(
        let(marked, read))


def candidate(
    stage: int, ordinal: int, value: Column, type_: Column, confidence: str, pattern_id: str,
    start: Column, end: Column, value_start: Column, value_end: Column,
) -> Column:
    return F.struct(
        F.lit(stage).alias("stage"), start.alias("start"), end.alias("end"), F.lit(ordinal).alias("ord"),
        value.alias("value"), type_.alias("type"), F.lit(confidence).alias("confidence"),
        F.lit(pattern_id).alias("pattern_id"), value_start.alias("value_start"), value_end.alias("value_end"),
    ).cast(CANDIDATE)


def merge(parts: Iterable[Column]) -> Column:
    parts = list(parts)
    return F.concat(*parts) if len(parts) > 1 else parts[0]


FEW = 48
STAGES = 4


def resolve_overlaps(candidates: Column) -> Column:
    """Take spans in (stage, start, end, rule) order; drop one that overlaps a span already taken; sort by position.

    Few candidates are compared with each other. Many are taken stage by stage: what is clear of the stages before is swept
    in order of start, with the last end as the only state. Stages beyond ``STAGES`` are compared as few are.
    """
    def step(taken: Column, x: Column) -> Column:
        clash = F.exists(taken, lambda t: (t["start"] < x["end"]) & (x["start"] < t["end"]))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(x)))

    def sweep(ordered: Column, stage: int, taken: Column) -> Column:
        own = F.filter(ordered, lambda c: c["stage"] == stage)
        free = own if stage == 0 else F.when((F.size(own) == 0) | (F.size(taken) == 0), own).otherwise(clear_of(own, taken, CANDIDATE))
        more = F.concat(taken, let(free, taken_in_order))
        return more if stage == STAGES - 1 else let(more, lambda now: sweep(ordered, stage + 1, now))

    def take(ordered: Column) -> Column:
        few = (F.size(ordered) <= FEW) | F.exists(ordered, lambda c: ~c["stage"].between(0, STAGES - 1))
        return F.when(few, F.aggregate(ordered, no_candidates(), step)).otherwise(sweep(ordered, 0, no_candidates()))

    def settle(found: Column) -> Column:
        taken = let(F.sort_array(found), take)
        return as_findings(F.sort_array(F.transform(taken, lambda t: F.struct(
            t["start"].alias("start"), t["end"].alias("end"), t["stage"].alias("stage"), t["ord"].alias("ord"),
            t["value"].alias("value"), t["type"].alias("type"), t["confidence"].alias("confidence"),
            t["pattern_id"].alias("pattern_id"), t["value_start"].alias("value_start"),
            t["value_end"].alias("value_end"),
        ))))

    return let(candidates, lambda c: F.when(F.size(c) == 0, as_findings(no_candidates())).otherwise(settle(c)))


def as_findings(spans: Column) -> Column:
    """The public shape of a finding."""
    return F.transform(spans, lambda t: F.struct(
        t["value"].alias("value"), t["type"].alias("type"), t["confidence"].alias("confidence"),
        t["start"].alias("start"), t["end"].alias("end"), t["pattern_id"].alias("pattern_id"),
        t["value_start"].alias("value_start"), t["value_end"].alias("value_end"),
    ))


def replace_matches(text: Column, regex: Column | str, replacement) -> Column:
    """Rebuild ``text`` with every match replaced by ``replacement(match)``, in a single left-to-right pass."""
    rx = F.lit(regex) if isinstance(regex, str) else regex
    return F.array_join(
        F.zip_with(
            F.split(text, rx, -1),
            F.regexp_extract_all(text, rx, F.lit(0)),
            lambda gap, hit: F.concat(gap, F.when(hit.isNull(), F.lit("")).otherwise(replacement(hit))),
        ),
        "",
    )


def alternation(values: Column) -> Column:
    """A regex that matches any of the given literals, longest first and equal lengths in text order."""
    ordered = F.sort_array(
        F.transform(values, lambda v: F.struct((-F.length(v)).alias("rank"), v.alias("v")))
    )
    quoted = F.transform(ordered, lambda s: F.concat(
        F.lit("\\Q"), F.replace(s["v"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.array_join(quoted, "|")
