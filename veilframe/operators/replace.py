"""Dictionary replacement in text: secrets to tokens, scoped or global.

A text's dictionary is the rules of its scope (document, conversation, session). Scopes with few rules carry them as
one map per scope; where the caller allows larger maps, workers hold them as automata, those that are too large for a worker
part by part. A scope with more rules than ``MAP_RULES`` is else never gathered: its texts are searched for rule
fingerprints, and only the rules that occur in a text meet that text again. All ways give the same result.
"""

from __future__ import annotations

import uuid
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.spans import alternation, let, replace_matches
from veilframe.session import BROADCAST_LIMIT_BYTES, broadcast_if_small, cut_lineage

MAP_RULES = 256
MAX_FILTER_BITS = 1 << 28  # 32 MB; rules beyond what it tells apart are searched in passes
BITS_PER_RULE = 16  # at least; as many more as a filter may have, up to FULL_BITS: what it lets through wrongly is shuffled
FULL_BITS = 64


def replace_with_pairs(text: Column, pairs: Column) -> Column:
    """Single-pass replacement by an array of (source, target): leftmost, longest at a position, non-overlapping."""

    def build(x: Column) -> Column:
        return replace_matches(text, x["rx"], lambda hit: F.coalesce(F.try_element_at(x["map"], hit), hit))

    prepared = F.struct(
        alternation(F.transform(pairs, lambda p: p["source"])).alias("rx"),
        F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["source"], p["target"]))).alias("map"),
    )
    usable = pairs.isNotNull() & (F.size(pairs) > 0)
    return F.when(usable & text.isNotNull(), let(prepared, build)).otherwise(text)


def count_matches(text: Column, pairs: Column) -> Column:
    rx = alternation(F.transform(pairs, lambda p: p["source"]))
    usable = pairs.isNotNull() & (F.size(pairs) > 0) & text.isNotNull()
    return F.when(usable, F.size(F.regexp_extract_all(text, rx, F.lit(0)))).otherwise(0)


def replace_scoped(
    df: DataFrame, rules: DataFrame, scope: list[str], keys: list[str], text: str, out: str,
    count: str | None = None, order: str | None = None, since: str | None = None, map_rules: int = MAP_RULES,
    gate: Column | None = None,
) -> DataFrame:
    """Replace in ``text`` by the rules of the row's scope.

    ``rules`` (scope, source, target) is a stored table or a checkpointed result. With ``order`` and ``since`` a rule
    counts only for rows at or after its registration. ``keys`` identify a row. Rows for which ``gate`` is false are
    known to hold no source: where the rules are too large to be broadcast, such rows skip the shuffle of the join.
    """
    # Of rules that share a source the earliest counts, then the first target in text order.
    place = F.struct(*([since] if since else []), "target")
    rules = rules.groupBy(*scope, "source").agg(F.min(place).alias("_first")).select(
        *scope, "source", "_first.target", *([f"_first.{since}"] if since else []))
    width = F.length("source") + F.length("target")
    sizes = rules.groupBy(*scope).agg(F.count("*").alias("n"), F.sum(width.cast("long")).alias("bytes"))
    facts = sizes.agg(
        F.sum("bytes").alias("bytes"), F.sum("n").alias("rules"),
        F.count_if(F.col("n") > map_rules).alias("big"), F.max("n").alias("most")).first()
    size_bytes = (facts["bytes"] or 0) + 64 * (facts["rules"] or 0)
    if gate is not None and (facts["big"] or size_bytes > BROADCAST_LIMIT_BYTES):
        hopeful = F.coalesce(gate, F.lit(False))
        plain = df.filter(~hopeful).withColumn(out, F.col(text))
        done = replace_scoped(df.filter(hopeful), rules, scope, keys, text, out, count, order, since, map_rules)
        return done.unionByName(plain.withColumn(count, F.lit(0)) if count else plain)
    if not facts["big"]:
        if (facts["most"] or 0) > MAP_RULES and not count and not since:
            if size_bytes <= BROADCAST_LIMIT_BYTES:
                return _replace_by_dictionaries(df, rules, scope, text, out)
            return _replace_by_parts(df, rules, scope, keys, text, out, -(-size_bytes // BROADCAST_LIMIT_BYTES))
        return _replace_by_maps(df, rules, scope, text, out, count, order, since, size_bytes)

    big = cut_lineage(sizes.filter(F.col("n") > map_rules).select(*scope))
    side, _ = broadcast_if_small(big, F.lit(64))
    few_rules = join_null_safe(rules, side, scope, "left_anti")
    few = _replace_by_maps(
        join_null_safe(df, side, scope, "left_anti"), few_rules, scope, text, out, count, order, since, size_bytes)
    many = _replace_by_search(
        join_null_safe(df, side, scope, "left_semi"), join_null_safe(rules, side, scope, "left_semi"), scope, keys, text, out, count,
        order, since)
    return few.unionByName(many)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on ``keys`` in which null meets null: a row whose key is null is a row like any other."""
    renamed = right.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)])
    return left.join(renamed, match, how).drop(*[f"_key_{i}" for i in range(len(keys))])


def _pairs(since: str | None) -> Column:
    fields = ["source", "target"] + ([since] if since else [])
    return F.collect_list(F.struct(*fields)).alias("_pairs")


def _finish(joined: DataFrame, columns: list[str], text: str, out: str, count: str | None,
            order: str | None, since: str | None) -> DataFrame:
    pairs = F.col("_pairs")
    if since:
        pairs = F.filter(pairs, lambda p: p[since] <= F.col(order))
    extra = [count_matches(F.col(text), pairs).alias(count)] if count else []
    return joined.select(*columns, replace_with_pairs(F.col(text), pairs).alias(out), *extra)


def _replace_by_maps(df, rules, scope, text, out, count, order, since, size_bytes: int) -> DataFrame:
    maps = rules.groupBy(*scope).agg(_pairs(since))
    if size_bytes <= BROADCAST_LIMIT_BYTES:
        maps = F.broadcast(maps)
    return _finish(join_null_safe(df, maps, scope, "left"), df.columns, text, out, count, order, since)


def _scope_name(scope: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(scope)])) if scope else F.lit("")


def _sent(rules: DataFrame, scope: list[str]):
    """The rules (scope's name, source, target) as Arrow bytes, which all workers get."""
    sink = pa.BufferOutputStream()
    held = rules.select(_scope_name(scope).alias("scope"), "source", "target").toArrow()
    with pa.ipc.new_stream(sink, held.schema) as writer:
        writer.write_table(held)
    return rules.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


_HELD: dict[str, dict] = {}


def _held_by_worker(name: str, sent, key: str, build):
    """What ``build`` makes of the pairs of a scope, once per worker, not per task; only rules last sent are held."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = {}
    held = _HELD[name]
    if key not in held:
        known = pa.ipc.open_stream(sent.value).read_all()
        own = known.filter(pc.equal(known["scope"], key))
        held[key] = build(list(zip(own["source"].to_pylist(), own["target"].to_pylist())))
    return held[key]


def _replace_by_dictionaries(df: DataFrame, rules: DataFrame, scope: list[str], text: str, out: str) -> DataFrame:
    """Maps with more rules than a row may carry: workers hold them as one automaton per scope, so that a text is passed over
    once, however many rules its scope has. The rules are broadcast, by measured size."""
    from veilframe.streaming.cutters import Dictionary

    sent, mark = _sent(rules, scope), uuid.uuid4().hex

    def replace(batches):
        for batch in batches:
            done = []
            for key, body in zip(batch.column("_scope").to_pylist(), batch.column("_text").to_pylist()):
                machine = _held_by_worker(mark, sent, key, Dictionary)
                done.append(None if body is None else machine.last(body))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(done, pa.string())], [*batch.schema.names[:-2], out])

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    return df.select("*", _scope_name(scope).alias("_scope"), F.col(text).alias("_text")).mapInArrow(replace, schema)


def _automaton(pairs: list[tuple[str, str]]) -> ahocorasick.Automaton | None:
    """Values: length and target. None if there is nothing to find."""
    machine = ahocorasick.Automaton()
    for source, target in pairs:
        if source:
            machine.add_word(source, (len(source), target))
    if not len(machine):
        return None
    machine.make_automaton()
    return machine


def _leftmost(text: str, found: list[tuple[int, int, str | None]]) -> tuple[str, int]:
    """The text with its occurrences (start, length, target) replaced: leftmost, longest at a place, without overlaps. And their
    number; a null target leaves its source."""
    out, at, n = [], 0, 0
    for start, size, target in sorted(found, key=lambda f: (f[0], -f[1])):
        if start >= at:
            out += [text[at:start], text[start:start + size] if target is None else target]
            at, n = start + size, n + 1
    out.append(text[at:])
    return "".join(out), n


def _occurrences(machine, text: str) -> list[tuple[int, int, str | None]]:
    """The longest occurrence at every place that has one."""
    longest: dict[int, tuple[int, str | None]] = {}
    for end, (size, target) in machine.iter(text):
        start = end + 1 - size
        if size > longest.get(start, (0, None))[0]:
            longest[start] = size, target
    return [(start, size, target) for start, (size, target) in longest.items()]


def _replace_by_parts(df: DataFrame, rules: DataFrame, scope: list[str], keys: list[str], text: str, out: str, parts: int) -> DataFrame:
    """As ``_replace_by_dictionaries`` for rules too large for a worker: dealt by hash to parts of at most that size, for one of
    which after the other all texts are passed over. Places that a part finds are written; those of all parts meet their text by
    its row, and are settled there."""
    row = list(dict.fromkeys([*keys, *scope]))
    given = df.withColumn("_digest", F.xxhash64(text))  # rows that share their keys keep their own places
    rules = cut_lineage(rules.select(*scope, "source", "target"))
    places = []

    def finder(sent, mark: str):
        def find(batches):
            for batch in batches:
                owners, found = [], []
                for i, (key, body) in enumerate(zip(batch.column("_scope").to_pylist(), batch.column("_text").to_pylist())):
                    machine = _held_by_worker(mark, sent, key, _automaton) if body else None
                    if machine and (own := _occurrences(machine, body)):
                        owners.append(i)
                        found.append([{"at": a, "size": n, "target": t} for a, n, t in own])
                kept = batch.select(batch.schema.names[:-2]).take(pa.array(owners, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, _PLACES)], [*kept.schema.names, "_places"])

        return find

    for part in range(parts):
        sent = _sent(rules.where(F.pmod(F.xxhash64("source"), F.lit(parts)) == part), scope)
        schema = T.StructType([*[given.schema[c] for c in (*row, "_digest")], _FOUND])
        places.append(cut_lineage(given.select(*row, "_digest", _scope_name(scope).alias("_scope"), F.col(text).alias("_text")).mapInArrow(
            finder(sent, uuid.uuid4().hex), schema)))
        sent.destroy()
    own = [*row, "_digest"]
    found = reduce(DataFrame.unionByName, places).groupBy(*own).agg(F.flatten(F.collect_list("_places")).alias("_places"))
    joined = join_null_safe(given, found, own, "left")
    settled = F.when(F.col("_places").isNotNull(), _settled(F.when(F.col("_places").isNotNull(), F.col(text)), F.col("_places")))
    return joined.select(*df.columns, F.coalesce(settled, F.col(text)).alias(out))


_FOUND = T.StructField("_places", T.ArrayType(T.StructType([
    T.StructField("at", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("target", T.StringType())])))
_PLACES = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("target", pa.string())]))


@F.arrow_udf(T.StringType())
def _settled(texts: pa.Array, places: pa.Array) -> pa.Array:
    return pa.array([None if body is None else _leftmost(body, [(f["at"], f["size"], f["target"]) for f in found])[0]
                     for body, found in zip(texts.to_pylist(), places.to_pylist())], pa.string())


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())]))
def _replaced_by_pairs(texts: pa.Array, pairs: pa.Array) -> pa.Array:
    """Each text with its own pairs, in time that grows with the text and the pairs, not with their product."""
    done = []
    for body, own in zip(texts.to_pylist(), pairs.to_pylist()):
        machine = _automaton([(p["source"], p["target"]) for p in own]) if body and own else None
        whole, n = _leftmost(body, _occurrences(machine, body)) if machine else (body, 0)
        done.append({"text": whole, "n": n})
    return pa.array(done, pa.struct([("text", pa.string()), ("n", pa.int32())]))


def _replace_by_search(df, rules, scope, keys, text, out, count, order, since) -> DataFrame:
    """Find which rules occur in which row, join exactly those, and replace per row."""
    row = list(dict.fromkeys([*keys, *scope, *([order] if order else [])]))
    hits = occurring_sources(df, rules, row, text)
    known = rules.select(*scope, "source", "target", *([since] if since else []))
    matched = join_null_safe(hits, known, [*scope, "source"], "inner")
    if since:
        matched = matched.filter(F.col(since) <= F.col(order))
    per_row = matched.groupBy(*row).agg(_pairs(None))  # by scope, too: rows of two scopes may share their keys
    joined = join_null_safe(df, per_row, row, "left")
    some = F.col("_pairs").isNotNull() & F.col(text).isNotNull()  # only such texts go to Python
    done = joined.withColumn("_done", _replaced_by_pairs(F.when(some, F.col(text)), F.when(some, F.col("_pairs"))))
    extra = [F.when(some, F.col("_done.n")).otherwise(0).alias(count)] if count else []
    return done.select(*df.columns, F.when(some, F.col("_done.text")).otherwise(F.col(text)).alias(out), *extra)


# ---- fingerprint search ------------------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of ``_BASE`` and of its inverse, ``n`` at least; those of usual texts are kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS
    made = []
    for base in (_BASE, _INVERSE):
        powers = np.full(1 << max(12, int(n - 1).bit_length()), base, dtype=np.uint64)
        powers[0] = 1
        made.append(np.multiply.accumulate(powers))
    if n <= 1 << 20:
        _POWERS[:] = made
    return made


class _Prefixes:
    """Hash of any window of a text from prefix sums; all arithmetic wraps modulo 2**64."""

    def __init__(self, text: str) -> None:
        codes = _codes(text) + np.uint64(1)
        self.n = len(codes)
        powers, self.inverse = _powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(codes * powers[:self.n], out=self.sums[1:])

    def windows(self, starts: np.ndarray, length: int) -> np.ndarray:
        raw = (self.sums[starts + length] - self.sums[starts]) * self.inverse[starts]
        return _mixed(raw + np.uint64(length))


def _set_bits(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bit set over hashes modulo ``bits``, built on the cluster; its size is fixed, whatever the number of rules."""
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = (
        hashes.select(F.shiftright(slot, 5).alias("w"), F.call_function(
            "shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(31)).cast("int")).alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    )
    table = np.zeros(bits // 32, dtype=np.uint32)
    table[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64).astype(np.uint32)
    return table


def _is_set(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(len(table) * 32 - 1)
    return (table[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & 1 == 1


def occurring_sources(df: DataFrame, rules: DataFrame, row: list[str], text: str) -> DataFrame:
    """(row, source) for every substring of a text that may be a rule's source; an equality join with the rules makes
    it exact. What is broadcast are two bit sets of fixed size. Where the rules are too many for such a set to tell texts apart,
    they are dealt by hash, and the texts are searched once for each part."""
    n = rules.count()
    passes = -(-n * BITS_PER_RULE // MAX_FILTER_BITS) or 1
    if passes == 1:
        return _occurring(df, rules, row, text)
    parts = []
    for i in range(passes):
        mine = F.pmod(F.xxhash64("source"), F.lit(passes)) == i
        own = rules.where(mine)
        if not own.isEmpty():  # a set may let through what belongs to another part, which is found there
            parts.append(cut_lineage(_occurring(df, own, row, text).where(mine)))
    return reduce(DataFrame.unionByName, parts)


def _occurring(df: DataFrame, rules: DataFrame, row: list[str], text: str) -> DataFrame:
    facts = rules.agg(F.count("*").alias("n"), F.min(F.length("source")).alias("shortest")).first()
    lengths = [r[0] for r in rules.select(F.length("source")).distinct().collect()]
    gram = min(8, facts["shortest"] or 1)
    bits = min(MAX_FILTER_BITS, 1 << max(20, int(facts["n"] * FULL_BITS).bit_length()))

    def hashed(batches):
        for batch in batches:
            heads, wholes = [], []
            for source in batch["source"]:
                p = _Prefixes(source)
                zero = np.zeros(1, dtype=np.int64)
                heads.append(p.windows(zero, gram)[0])
                wholes.append(p.windows(zero, p.n)[0])
            yield pd.DataFrame({"head": np.array(heads, dtype=np.uint64).astype(np.int64),
                                "whole": np.array(wholes, dtype=np.uint64).astype(np.int64)})

    marks = cut_lineage(rules.select("source").mapInPandas(hashed, "head long, whole long"))
    context = df.sparkSession.sparkContext
    heads = context.broadcast(_set_bits(marks.select(F.col("head").alias("h")), bits))
    wholes = context.broadcast(_set_bits(marks.select(F.col("whole").alias("h")), bits))

    def search(batches):
        for batch in batches:
            owners, sources = [], []
            for i, body in enumerate(batch["_text"]):
                if not body or len(body) < gram:
                    continue
                p = _Prefixes(body)
                starts = np.arange(p.n - gram + 1)
                starts = starts[_is_set(heads.value, p.windows(starts, gram))]
                found = set()
                for length in lengths:
                    fit = starts[starts + length <= p.n]
                    for at in fit[_is_set(wholes.value, p.windows(fit, length))] if len(fit) else ():
                        found.add(body[at:at + length])
                owners.extend([i] * len(found))
                sources.extend(found)
            hit = batch.iloc[owners].drop(columns="_text").reset_index(drop=True)
            hit["source"] = pd.Series(sources, dtype="object")
            yield hit

    schema = T.StructType([*[df.schema[c] for c in row], T.StructField("source", T.StringType())])
    return df.select(*row, F.col(text).alias("_text")).mapInPandas(search, schema)
