"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

The reader takes plain and gzip archives. A record counts when its version line, header, length, end mark and payload
digest (a gzip member: its checksum too) hold. After a failed check it looks for the next version line or gzip member
that passes them all, goes on there, and logs the bytes between as a gap with its reason.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import free_name, lean
from veilframe.session import broadcast_if_small, cut_lineage

END = "\r\n\r\n"
REVISIT_BYTES = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_STEP = 1 << 16
_INNER = re.compile(rb"WARC/[0-9]")
_MOST_HEADER = 1 << 20
_START = re.compile(rb"WARC/[0-9]\.[0-9]+\r\n|\x1f\x8b\x08")
_RECORDS = ("path string, offset bigint, length bigint, kind string, reason string, record_type string, record_id string, "
            "target_uri string, date string, refers_to string, payload_digest string, payload_bytes bigint, payload binary")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   date: str = "1970-01-01T00:00:00Z", records_per_file: int = 5000) -> None:
    """One record per row, in uncompressed WARC files below ``path``, on any file system that Spark writes to.

    Of rows with the same payload of at least 1000 bytes, that with the largest identifier is a response, and the others
    are revisits that refer to it. Null payloads are empty, a null identifier or address is written as an empty one; rows
    that repeat the largest identifier are all responses. Other columns are not read.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "[\\r\\n]+", " ").alias("url"),
        payload.alias("payload"), F.octet_length(payload).alias("n"), F.sha2(payload, 256).alias("key"))
    groups = rows.where(F.col("n") >= REVISIT_BYTES).groupBy("key", "n").agg(
        F.max("id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL").drop("copies")
    # The groups are a narrow table; only when they are measured to be small do the pages stay where they are.
    groups, _ = broadcast_if_small(cut_lineage(groups), F.lit(100))
    found = rows.join(groups, ["key", "n"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit(_HTTP), F.col("n").cast("string"), F.lit(END))

    def uri(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    head = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", uri("id")), field("WARC-Target-URI", F.col("url")), field("WARC-Date", F.lit(date)),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("payload"))),
        F.when(revisit, F.concat(field("WARC-Refers-To", uri("first")), field("WARC-Profile", F.lit(_PROFILE)),
                                 field("X-Payload-Length", F.col("n").cast("string")))).otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http; msgtype=response")))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("payload")))
    record = F.concat(head, field("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)
    # The writer ends each row with its line separator, which is the end mark of a record.
    found.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


class _Bad(ValueError):
    pass


def _record(data: bytes, at: int) -> tuple[int, dict]:
    """The record at ``at`` and the place after it; _Bad with the reason if it fails a check."""
    end = data.find(b"\r\n\r\n", at, at + _MOST_HEADER)
    if end < 0:
        raise _Bad("header does not end")
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Bad("header line without a colon")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    size = fields.get(b"content-length", "")
    if not size.isascii() or not size.isdigit():
        raise _Bad("no content length")
    start, stop = end + 4, end + 4 + int(size)
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise _Bad("no end mark after the content")
    payload = data[start:stop]
    if "application/http" in fields.get(b"content-type", ""):
        payload = payload.partition(b"\r\n\r\n")[2]
    digest = fields.get(b"warc-payload-digest", "")
    kind = fields.get(b"warc-type", "")
    if kind != "revisit" and digest.lower().startswith("sha1:"):
        found = hashlib.sha1(payload).digest()
        if digest[5:].lower() not in (found.hex(), base64.b32encode(found).decode().lower()):
            raise _Bad("payload digest differs")
    return stop + 4, {"type": kind, "fields": fields, "payload": payload, "digest": digest}


def _inflated(data: bytes, at: int) -> tuple[int, bytes, str]:
    """The content of the gzip member at ``at`` as far as it can be had, the place after it, and what is wrong with it. A step that
    fails is taken again byte by byte, up to the damage."""
    inflate, out, place = zlib.decompressobj(31), [], at
    view = memoryview(data)
    while not inflate.eof and place < len(data):
        before = inflate.copy()
        try:
            out.append(inflate.decompress(view[place:place + _STEP]))
        except zlib.error as error:
            try:
                for i in range(place, min(place + _STEP, len(data))):
                    out.append(before.decompress(view[i:i + 1]))
            except zlib.error:
                pass
            return -1, b"".join(out), f"gzip member: {error}"
        place += _STEP
    if not inflate.eof:
        return -1, b"".join(out), "gzip member does not end"
    return min(place, len(data)) - len(inflate.unused_data), b"".join(out), ""


def _member(data: bytes, at: int) -> tuple[int, list[tuple[dict | None, str]], str]:
    """The records of the gzip member at ``at`` (a gap in its content as None with the reason), the place after it, and what is
    wrong with the member itself; then the place is where something may start again, and only sound records count."""
    after, content, wrong = _inflated(data, at)
    if wrong:
        following = _START.search(data, at + 1)
        after = following.start() if following else len(data)
    found: list[tuple[dict | None, str]] = []
    place = 0
    while place < len(content):
        try:
            if not content.startswith(b"WARC/", place):
                raise _Bad("no version line")
            place, record = _record(content, place)
            found.append((record, ""))
        except _Bad as error:
            following = _INNER.search(content, place + 1)
            stop = following.start() if following else len(content)
            if found and found[-1][0] is None:  # one gap, as long as nothing sound lies in it
                found[-1] = (None, f"{found[-1][1].rpartition('-')[0]}-{stop}")
            else:
                found.append((None, f"in a member, {error}, bytes of its content {place}-{stop}"))
            place = stop
    return after, [f for f in found if f[0] is not None] if wrong else found, wrong


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """(offset, length, record or None, reason): the records of an archive in order, and the gaps between them.

    A damaged gzip member gives the sound records that inflate from it, and a gap over the member; a damaged record inside a
    sound member gives a gap at the member's place that names the bytes of its content."""
    at, bad_from, reason = 0, -1, ""
    while at < len(data):
        found: list[tuple[dict | None, str]] = []
        try:
            if data.startswith(b"\x1f\x8b", at):
                after, found, wrong = _member(data, at)
                if wrong:
                    if bad_from < 0 and found:
                        yield from ((at, after - at, record, "") for record, _ in found)
                    elif found:
                        yield bad_from, at - bad_from, None, reason
                        yield from ((at, after - at, record, "") for record, _ in found)
                        bad_from = -1
                    raise _Bad(wrong)
                if not any(record for record, _ in found):
                    raise _Bad("gzip member holds no record")
            elif data.startswith(b"WARC/", at):
                after, record = _record(data, at)
                found.append((record, ""))
            else:
                raise _Bad("neither a version line nor a gzip member")
        except _Bad as error:
            if bad_from < 0:
                bad_from, reason = at, str(error)
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if bad_from >= 0:
            yield bad_from, at - bad_from, None, reason
            bad_from = -1
        for record, why in found:
            yield at, after - at, record, why
        at = after
    if bad_from >= 0:
        yield bad_from, len(data) - bad_from, None, reason


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records (``kind`` record) and gaps (``kind`` gap) of all archives below a path.

    A gap has its offset, length and reason. ``payload_digest`` is bare lower-case hex SHA-1 of the full payload; a revisit
    carries the digest and length that its header states, and no payload. A file is read by one task, so archives should
    have the usual size, a gigabyte at most. An empty file has no rows.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _RECORDS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 8, pa.int64(), pa.binary()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, held = [], 0
                for offset, length, record, reason in salvage(content.as_py()):
                    if record is None:
                        rows.append((file, offset, length, "gap", reason, *[None] * 8))
                        continue
                    fields, payload = record["fields"], record["payload"]
                    revisit = record["type"] == "revisit"
                    stated = fields.get(b"x-payload-length", "")
                    digest = record["digest"].partition(":")[2].lower() if revisit else hashlib.sha1(payload).hexdigest()
                    rows.append((
                        file, offset, length, "record", None, record["type"], fields.get(b"warc-record-id"),
                        fields.get(b"warc-target-uri"), fields.get(b"warc-date"), fields.get(b"warc-refers-to"), digest,
                        (int(stated) if stated.isdigit() else None) if revisit else len(payload), None if revisit else payload))
                    held += len(payload) + 500
                    if held > 1 << 22:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lean(parse), _RECORDS)


def page_number(uri: Column) -> Column:
    """The identifier in a record's or a reference's name; null for an empty one."""
    return F.regexp_extract(uri, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")


def archive_round_trip(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the pages to archives below ``path`` and read them back: one row per page; fails if bytes had to be given up."""
    write_archives(pages, path, id_col, url_col, payload_col)
    rows = read_archives(pages.sparkSession, path)
    name = free_name(["payload_bytes", "payload_digest", "record_type", "refers_to"], id_col)
    whole = F.when(F.col("kind") == "gap", F.raise_error(F.concat(F.lit("gap in "), F.col("path")))).otherwise(page_number(F.col("record_id")))
    return rows.select(whole.cast("bigint").alias(name), "payload_bytes", "payload_digest", "record_type",
                       page_number(F.col("refers_to")).alias("refers_to"))
