"""Removal of repeated byte strings with a sparse, range-partitioned suffix array.

A string of ``LENGTH`` bytes is found through its anchor: the least (by a hash) ``GRAM``-byte token sequence inside it, the
leftmost of equals. Equal strings have equal anchors at equal distances, so suffixes need to be compared only around
anchors, one in some 85 bytes. A run is the strings in a row that share an anchor.

1. Runs whose anchor occurs once in the corpus go. Runs of equal content (two hashes of all their bytes) are one class;
   strings of a class with two members repeat. What is left are the borders of repeated passages.
2. For anchors with several classes, each class gives suffixes at every ``BAND`` bytes before its anchor. Sampled splitters
   range-partition them by their leading bytes, those that all strings of a band share; splitters never part suffixes that
   are equal there, so a string is not compared across a bucket border in vain. Buckets sort their suffixes locally by
   multikey quicksort over 8-byte words; from the common prefixes of neighbours, and the bytes before the suffix, follows which
   strings of the band occur twice. A group of equal leading bytes that is too large for a bucket is split by its whole
   strings instead.
3. Repeated strings are laid over the texts; their union is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import U64, byte_hashes, lean, mix, pieces, random_words, signed, sliding_min, utf8
from veilframe.session import cut_lineage

LENGTH = 200
GRAM = 32
BAND = 32
LEAD = LENGTH - BAND + 1
WIDE = 20_000
_SPAN = 1 << 20
_RUNS = "kh bigint, rh bigint, h1 bigint, h2 int, at bigint"
_LOW = U64((1 << 24) - 1)


def anchored_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor place, first and last string start of each run, its anchor's hash and its content's hash."""
    n = len(data)
    valid = np.zeros(n, bool)
    for a, b in zip(bounds[:-1], bounds[1:]):
        valid[a:max(a, b - LENGTH + 1)] = True
    if not valid.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.view(U64), empty.view(U64)
    at = np.arange(n - GRAM + 1)
    packed = byte_hashes(data, at, at + GRAM, 0) & ~_LOW | at.astype(U64)
    least = (sliding_min(packed, LENGTH - GRAM + 1) & _LOW).astype(np.int64)
    starts = np.flatnonzero(valid)
    anchor = least[starts]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]
    first = starts[new]
    last = starts[np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]]
    anchor = anchor[new]
    kh = byte_hashes(data, anchor, anchor + GRAM, 1)
    place = ((anchor - first) << 20 | (last - first)).astype(U64)
    rh = mix(byte_hashes(data, first, last + LENGTH, 0) + mix(place + U64(1)) + byte_hashes(data, first, last + LENGTH, 1))
    return anchor, first, last, kh, rh


def _segments(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Whole texts, some at a time, and very long texts in overlapping parts: (first row, bytes, bounds, shift)."""
    for a, b in pieces(bounds, _SPAN):
        part = data[bounds[a]:bounds[b]]
        if len(part) <= 2 * _SPAN:
            yield a, part, bounds[a:b + 1] - bounds[a], 0
            continue
        for s in range(0, len(part) - LENGTH + 1, _SPAN):
            cut = part[s:s + _SPAN + LENGTH - 1]
            yield a, cut, np.array([0, len(cut)]), s


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = utf8(batch.column("text"))
        h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
        for row, part, limits, shift in _segments(data, bounds):
            anchor, first, last, kh, rh = anchored_runs(part, limits)
            if not len(anchor):
                continue
            of = np.searchsorted(limits, anchor, side="right") - 1
            # place of the anchor in the text, and the least and largest distance of a string's start before it
            at = (anchor - limits[of] + shift) << 16 | (anchor - last) << 8 | (anchor - first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(kh)), pa.array(signed(rh)), pa.array(h1[row + of]), pa.array(h2[row + of].astype(np.int32)),
                 pa.array(at)], ["kh", "rh", "h1", "h2", "at"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes of each class: one per band of distances, with the bytes before it that strings of the band have."""
    for batch in batches:
        out: list[tuple] = []
        for kh, rh, lo, hi, content in zip(*(batch.column(c).to_pylist() for c in ("kh", "rh", "lo", "hi", "content"))):
            for band in range(lo // BAND, hi // BAND + 1):
                least, most = max(lo - band * BAND, 0), min(hi - band * BAND, BAND - 1)
                s = hi - band * BAND  # of the suffix in the content, which starts ``hi`` before the anchor
                out.append((kh, rh, band, least, most, content[s:s + LEAD], content[s - most:s], content[s + LEAD:s + LENGTH - least]))
        for a in range(0, len(out), 4096):
            columns = list(zip(*out[a:a + 4096]))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["kh", "rh", "band", "least", "most", "lead", "before", "after"])


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """The order of rows of words: by the first word, then, inside each run of equals, by the next, and so on."""
    order = np.arange(len(words))
    group = np.zeros(len(words), np.int64)
    active = np.arange(len(words))  # places in the order whose group has more than one row
    for depth in range(words.shape[1]):
        if not len(active):
            break
        key = words[order[active], depth]
        turn = np.lexsort((key, group[active]))
        order[active] = order[active][turn]
        key, old = key[turn], group[active]
        split = np.r_[True, (key[1:] != key[:-1]) | (old[1:] != old[:-1])]
        group[active] = active[split][np.cumsum(split) - 1]
        size = np.bincount(np.cumsum(split) - 1)
        active = active[(size > 1)[np.cumsum(split) - 1]]
    return order


def _padded(column: list[bytes], width: int, right: bool = False) -> np.ndarray:
    pad = bytes.rjust if right else bytes.ljust
    return np.frombuffer(b"".join(pad(x, width, b"\0") for x in column), np.uint8).reshape(len(column), width)


_LEFT = random_words(21, 256)
_FACTORS = random_words(22, BAND) | U64(1)


def repeated_masks(rows: pa.Table) -> np.ndarray:
    """Per suffix of a bucket a bit for each string of its band that another suffix of the bucket has too."""
    width = -(-LENGTH // 8) * 8
    lead, after = rows.column("lead").to_pylist(), rows.column("after").to_pylist()
    text = _padded([a + b for a, b in zip(lead, after)], width)
    before = _padded(rows.column("before").to_pylist(), BAND, right=True)
    band, least, most = (rows.column(c).to_numpy() for c in ("band", "least", "most"))
    words = np.concatenate([text[:, :LEAD - LEAD % 8], text[:, LEAD - LEAD % 8:]], axis=1).copy().view(">u8").astype(U64)
    order = multikey_sort(np.concatenate([band.astype(U64)[:, None], words], axis=1))
    sorted_text = text[order]
    differs = np.concatenate([sorted_text[1:] != sorted_text[:-1], np.ones((len(order) - 1, 1), bool)], axis=1)
    common = np.where(band[order][1:] == band[order][:-1], differs.argmax(axis=1), 0)
    masks, hashed = np.zeros(len(order), np.int64), np.zeros(len(order), U64)
    for e in range(BAND):
        if e:
            hashed = hashed + _LEFT[before[order, BAND - e]] * _FACTORS[e]
        segment = np.r_[0, np.cumsum(common < LENGTH - e)].astype(U64)
        here = np.flatnonzero((least[order] <= e) & (most[order] >= e))
        if len(here) < 2:
            continue
        key = mix(hashed[here] + mix(segment[here] + U64(1)))
        turn = np.argsort(key)
        same = key[turn][1:] == key[turn][:-1]
        twice = np.r_[same, False] | np.r_[False, same]
        masks[order[here[turn[twice]]]] |= 1 << e
    return masks


def _mask_batch(rows: pa.Table) -> pa.RecordBatch:
    masks = repeated_masks(rows)
    kept = pa.array(masks != 0)
    table = rows.select(["kh", "rh", "band"]).append_column("mask", pa.array(masks)).filter(kept).combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket arrives in the order of leading bytes; it is worked off in parts that part no equal ones."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.num_rows
        if size > 2 * WIDE:
            table = pa.Table.from_batches(held).combine_chunks()
            lead = table.column("lead").to_pylist()
            cut = len(lead) - 1
            while cut > 0 and lead[cut - 1] == lead[-1]:
                cut -= 1
            if cut:
                yield _mask_batch(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            size = table.num_rows - cut
    if held:
        yield _mask_batch(pa.Table.from_batches(held))


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of suffixes whose leading bytes are too common for one bucket, by two hashes."""
    for batch in batches:
        for row in batch.to_pylist():
            content = np.frombuffer(row["before"] + row["lead"] + row["after"], np.uint8)
            e = np.arange(row["least"], row["most"] + 1)
            start = row["most"] - e
            n = len(e)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, row["kh"])), pa.array(np.full(n, row["rh"])), pa.array(np.full(n, row["band"], np.int32)),
                 pa.array(e), pa.array(signed(byte_hashes(content, start, start + LENGTH, 0))),
                 pa.array(signed(byte_hashes(content, start, start + LENGTH, 1)))], ["kh", "rh", "band", "e", "s1", "s2"])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges [from, to) that a member's repeated strings cover."""
    for batch in batches:
        h1, h2, at, n, band, mask = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "at", "n", "band", "mask"))
        anchor, lo, hi = at >> 16, at >> 8 & 255, at & 255
        whole = np.flatnonzero(n > 1)
        rows, begin, end = [whole], [anchor[whole] - hi[whole]], [anchor[whole] - lo[whole] + LENGTH]
        for e in range(BAND):
            some = np.flatnonzero((n == 1) & (mask.astype(np.int64) >> e & 1 == 1))
            rows.append(some)
            begin.append(anchor[some] - band[some] * BAND - e)
            end.append(begin[-1] + LENGTH)
        i, begin, end = np.concatenate(rows), np.concatenate(begin), np.concatenate(end)
        turn = np.lexsort((begin, i))
        i, begin, end = i[turn], begin[turn], end[turn]
        if len(i):  # strings of a member and band that follow each other are one range
            new = np.r_[True, (i[1:] != i[:-1]) | (begin[1:] > end[:-1])]
            first = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[i[first]]), pa.array(h2[i[first]].astype(np.int32)), pa.array(begin[first].astype(np.int64)),
                 pa.array(np.maximum.reduceat(end, first).astype(np.int64))], ["h1", "h2", "begin", "end"])


def _repeated(texts: DataFrame) -> DataFrame:
    """h1, h2 and the sorted ranges (begin, end) of every text with a repeated string."""
    runs = cut_lineage(texts.where(F.octet_length("text") >= LENGTH).mapInArrow(lean(_runs), _RUNS))
    often = runs.groupBy("kh").agg(F.count("*").alias("times")).where("times > 1").select("kh")
    members = cut_lineage(runs.join(often, "kh").groupBy("kh", "rh", "h1", "h2", "at").agg(F.count("*").alias("m")))
    classes = cut_lineage(members.groupBy("kh", "rh").agg(F.sum("m").alias("n"), F.min(F.struct("h1", "h2", "at")).alias("rep")))
    mixed = classes.groupBy("kh").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1").select("kh")
    at = F.col("rep.at")
    wanted = classes.join(mixed, "kh").select(
        "rep.h1", "rep.h2", F.struct("kh", "rh", F.shiftright(at, 16).alias("anchor"), F.shiftright(at, 8).bitwiseAND(255).alias("lo"),
                                     at.bitwiseAND(255).alias("hi")).alias("c"))
    lists = wanted.groupBy("h1", "h2").agg(F.collect_list("c").alias("cs"))  # of one text, so bounded by it
    raw = F.col("text").cast("binary")
    contexts = texts.join(lists, ["h1", "h2"]).select(F.explode(F.transform("cs", lambda c: F.struct(
        c["kh"].alias("kh"), c["rh"].alias("rh"), c["lo"].alias("lo"), c["hi"].alias("hi"),
        F.substring(raw, (c["anchor"] - c["hi"] + 1).cast("int"), (c["hi"] - c["lo"] + LENGTH).cast("int")).alias("content")))).alias("c")).select("c.*")
    contexts = contexts.dropDuplicates(["kh", "rh"])
    suffixes = cut_lineage(contexts.mapInArrow(
        lean(_bands), "kh bigint, rh bigint, band int, least int, most int, lead binary, before binary, after binary"))
    lead = F.xxhash64("lead", "band").alias("lead_hash")
    large = suffixes.groupBy(lead).agg(F.count("*").alias("m")).where(F.col("m") > WIDE).select("lead_hash")
    keyed = suffixes.withColumn("lead_hash", lead)
    buckets = keyed.join(large, "lead_hash", "left_anti").drop("lead_hash").repartitionByRange("lead").sortWithinPartitions("lead")
    schema = "kh bigint, rh bigint, band int, mask bigint"
    sorted_masks = buckets.mapInArrow(lean(_sorted_buckets), schema)
    strings = keyed.join(large, "lead_hash").drop("lead_hash").mapInArrow(
        lean(_string_rows), "kh bigint, rh bigint, band int, e bigint, s1 bigint, s2 bigint")
    twice = strings.groupBy("s1", "s2", "band", "e").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    wide_masks = strings.join(twice, ["s1", "s2", "band", "e"]).groupBy("kh", "rh", "band").agg(
        F.sum(F.expr("shiftleft(1L, cast(e as int))")).alias("mask"))
    masks = cut_lineage(sorted_masks.union(wide_masks))
    sized = members.select("kh", "rh", "h1", "h2", "at").join(classes.select("kh", "rh", "n"), ["kh", "rh"])
    none = F.lit(0).cast("int")
    whole = sized.where("n > 1").select("h1", "h2", "at", "n", none.alias("band"), F.lit(0).cast("bigint").alias("mask"))
    part = sized.where("n = 1").join(masks, ["kh", "rh"]).select("h1", "h2", "at", "n", "band", "mask")
    spans = whole.union(part).mapInArrow(lean(_spans), "h1 bigint, h2 int, begin bigint, end bigint")
    return spans.groupBy("h1", "h2").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("ranges"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        ids, sizes, spans, kept = batch.column("id"), [], [], []
        for text, ranges in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("ranges").to_pylist()):
            text, out, rest, at = text or b"", [], [], 0
            for r in ranges or ():
                if out and r["begin"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], r["end"])
                else:
                    out.append({"start": r["begin"], "end": r["end"]})
            for s in out:
                rest.append(text[at:s["start"]])
                at = s["end"]
            sizes.append(len(text))
            spans.append(out)
            kept.append(b"".join([*rest, text[at:]]))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def remove_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its identifier, ``n_bytes``, ``spans`` (start, end of each maximal removed run of bytes) and ``kept`` (bytes).

    A byte is removed if some string of 200 bytes over it also starts anywhere else, in the same or another text; strings
    overlap freely, do not cross texts, and are judged on the input. Null text is empty; texts under 200 bytes stay whole.
    Rows that repeat count as texts of their own: a text of 200 bytes or more that stands twice is removed from both. Very
    long texts are worked off in overlapping parts. Other columns are not read. Empty in, empty out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("h1"),
                       F.hash(text).alias("h2"), text.alias("text"))
    found = cut_lineage(_repeated(rows.select("h1", "h2", "text")))
    return rows.join(found, ["h1", "h2"], "left").select("id", "text", "ranges").mapInArrow(
        lean(_cut), "id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary").withColumnRenamed("id", id_col)
