"""Legacy archives to WARC: ARC archives in, WARC files out, and back.

An ARC archive begins with a version block; each record is a header line, whose fields depend on the
version (version 1: five, version 2: ten), and as many bytes as it declares. The converter walks an
archive by these lengths and derives the WARC record's identifier from the payload digest and the
page, its time from the 14-digit date, its type from the content and from whether an equal payload
is stored already, and its digests from the bytes.

Both kinds of archive are written by Spark's text sink, whose line separator is what closes a
record, so executors write real archives (gzip) to any file system that Spark knows. An archive has
RECORDS lines, the version block among them; one that holds ARCHIVE_BYTES before that is filled up
with empty lines, which readers of both formats skip, so no archive is larger than that and one
record. They are read with the binary file source and decompressed record by record.

Of equal payloads of at least REVISIT_BYTES bytes the page of smallest id is stored, the others
are revisits of it. A first walk over the archives gathers digests, of which only those found twice
are kept; the second converts. A digest of very many pages is aggregated before it is shuffled, and the
join back is Spark's skew-aware one (or a broadcast, if Spark finds the kept digests small enough).

Defined results: null html is an empty payload; a null url becomes `urn:page:<id>`; white space in a
url is percent-encoded; of repeated rows with the smallest id all are responses; a null page_id never
stands for others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bounded, fresh_path, remove

REVISIT_BYTES = 100
#: Lines of an archive file and its bytes (before compression), about.
RECORDS, ARCHIVE_BYTES = 1 << 14, 1 << 25
#: Bytes of records that are handed on at once.
BATCH = 1 << 21
VERSION = "WARC/1.1"

# The header fields of the two ARC versions, in order.
ARC_FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "status", "checksum", "location", "offset", "filename", "length"),
}


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    content: bytes


def safe_url(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def arc_head(version: int, name: str, date: str) -> bytes:
    """The version block that opens an archive."""
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 termsieve\n{names[version]}\n".encode()
    more = "" if version == 1 else "200 - - 0 " + safe_url(name) + " "
    return f"filedesc://{safe_url(name)} 0.0.0.0 {date} text/plain {more}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, content: bytes, name: str = "-", offset: int = 0) -> bytes:
    more = "" if version == 1 else f"200 - - {offset} {safe_url(name)} "
    return f"{safe_url(url)} 0.0.0.0 {date} text/html {more}{len(content)}\n".encode() + content + b"\n"


def parse_arc(raw: bytes | BinaryIO) -> Iterator[ArcRecord]:
    """Records of one archive, without the version block. The version is the first number of that
    block; header lines are split from the right, since only the url may hold odd characters."""
    f, version = io.BytesIO(raw) if isinstance(raw, bytes) else raw, None
    while whole := f.readline():
        if not whole.strip(b"\r\n"):
            continue
        if not whole.endswith(b"\n"):
            raise ValueError("an ARC header line has no end")
        line = whole.rstrip(b"\r\n").decode("utf-8", "surrogateescape")
        names = ARC_FIELDS[version or (2 if line.count(" ") >= 9 else 1)]
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header line: {line[:100]!r}")
        content = f.read(int(parts[-1]))
        if len(content) != int(parts[-1]):
            raise ValueError("an ARC record is shorter than declared")
        if version is None and line.startswith("filedesc:"):
            version = int(content.split(None, 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
        else:
            version = version or (1 if len(names) == 5 else 2)
            yield ArcRecord(version, dict(zip(names, parts)), content)


def record_id(digest: str, page: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{digest} {page}'.encode()).digest()[:16], version=4)}>"


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, header bytes and payload of an HTTP message; without a status line all is payload."""
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    head, gap, body = block.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]))
    return fields, head + gap, body


def to_warc(arc: ArcRecord, same_as: str | None = None) -> bytes:
    """The WARC record of an ARC record, without its closing line breaks. same_as: the page whose
    equal payload is stored; the record is then a revisit and keeps the HTTP header only."""
    fields, head, body = http_parts(arc.content)
    digest = hashlib.sha256(body).hexdigest()
    page = fields.get("x-page-id", "")
    d = arc.fields["date"].ljust(14, "0")
    lines = [
        VERSION,
        f"WARC-Type: {'revisit' if same_as is not None else 'response' if head else 'resource'}",
        f"WARC-Record-ID: {record_id(digest, page)}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {arc.fields['url']}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    block = arc.content
    if same_as is not None:
        block = head
        lines += [f"WARC-Refers-To: {record_id(digest, same_as)}", f"WARC-Refers-To-Page: {same_as}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Type: {'application/http; msgtype=response' if head else arc.fields['content_type']}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block


def parse_warc(raw: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record."""
    f = io.BytesIO(raw) if isinstance(raw, bytes) else raw
    while line := f.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:100]!r}")
        fields = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields["content-length"])
        block = f.read(size)
        if len(block) != size:
            raise ValueError("a WARC record is shorter than declared")
        yield fields, block


def http_block(page: str, payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def _unpacked(raw: bytes) -> BinaryIO:
    f = io.BytesIO(raw)
    return io.BufferedReader(gzip.GzipFile(fileobj=f), 1 << 18) if raw[:2] == b"\x1f\x8b" else f


def _by_bytes(rows: Iterable[tuple], kinds: dict[str, pa.DataType], size) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose sizes add up to BATCH, about."""
    held, n = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.values())], list(kinds))

    for row in rows:
        held.append(row)
        n += 64 + size(row)
        if n >= BATCH:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


def _lines(items: Iterable, line: Callable[[int, object], bytes], head: Callable[[int], bytes] | None, records: int, most: int) -> Iterator[tuple[bytes]]:
    """The lines of archives: head(number) opens each, line(number, item) follows for each item, and where
    `most` bytes come before `records` lines empty ones fill it up."""
    number = lines = size = 0
    for item in items:
        if not lines and head:
            opening = head(number)
            yield (opening,)
            lines, size = 1, len(opening)
        one = line(number, item)
        yield (one,)
        lines, size = lines + 1, size + len(one)
        if size >= most:
            for _ in range(records - lines):
                yield (b"",)
            lines = records
        if lines == records:
            number, lines, size = number + 1, 0, 0


def _write_lines(lines: DataFrame, path: str, end: str, records: int) -> None:
    """lines: one binary column. Quick compression: archives are read once or twice."""
    out = lines.select(F.col("record").cast("string").alias("value")).write.option("lineSep", end)
    out.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records).text(path)


RECORD = {"record": pa.binary()}


def write_arc(pages: DataFrame, path: str, date: str = "20000101000000", records: int = RECORDS, most: int = ARCHIVE_BYTES) -> None:
    """pages(page_id, url, html) as ARC archives in `path`, by turns of version 1 and 2."""
    name = F.coalesce(F.col("page_id").cast("long").cast("string"), F.lit(""))
    rows = bounded(pages).select(name.alias("page"), F.coalesce(F.col("url").cast("string"), F.concat(F.lit("urn:page:"), name)).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))

    def run(batches):
        part = TaskContext.get().partitionId()
        version = lambda number: 1 + (part + number) % 2
        # The sink's line separator is the line break that closes a record.
        head = lambda number: arc_head(version(number), f"pages-{part}-{number}.arc", date)[:-1]
        line = lambda number, row: arc_record(version(number), row[1], date, http_block(row[0], row[2]))[:-1]
        yield from _by_bytes(_lines(_rows(batches), line, head, records, most), RECORD, lambda r: len(r[0]))

    _write_lines(rows.mapInArrow(run, "record binary"), path, "\n", records)


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return bounded(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content"))


ARC_ROW = {"page": pa.string(), "digest": pa.string(), "size": pa.int64(), "version": pa.int32(), "url": pa.string(), "date": pa.string(), "content_type": pa.string(), "content": pa.binary()}


def read_arc(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """One row per ARC record: page (of its HTTP header), digest and size of the payload, and (where
    wanted) what the record holds."""

    def run(batches):
        def records():
            for (raw,) in _rows(batches):
                for arc in parse_arc(_unpacked(raw)):
                    http, _, body = http_parts(arc.content)
                    row = (http.get("x-page-id"), hashlib.sha256(body).hexdigest(), len(body))
                    yield row + (arc.version, arc.fields["url"], arc.fields["date"], arc.fields["content_type"], arc.content) if content else row

        kinds = ARC_ROW if content else {k: ARC_ROW[k] for k in ("page", "digest", "size")}
        yield from _by_bytes(records(), kinds, lambda r: len(r[-1]) if content else 0)

    schema = "page string, digest string, size long" + (", version int, url string, date string, content_type string, content binary" if content else "")
    return _files(spark, path).mapInArrow(run, schema)


def convert(spark: SparkSession, arc_path: str, warc_path: str, records: int = RECORDS, most: int = ARCHIVE_BYTES) -> None:
    """The ARC archives of a folder as WARC files in another."""
    page = F.expr("try_cast(page AS BIGINT)")
    large = read_arc(spark, arc_path, content=False).where(F.col("size") >= REVISIT_BYTES)
    stored = large.groupBy("digest", "size").agg(F.min(page).alias("stored"), F.count(F.lit(1)).alias("n")).where("n > 1 AND stored IS NOT NULL").drop("n")
    # Written, so that Spark knows its size before it plans the join: payloads move only if it is not small.
    path = fresh_path(spark, "stored")
    stored.write.parquet(path)
    rows = read_arc(spark, arc_path).join(spark.read.schema("digest string, size long, stored long").parquet(path), ["digest", "size"], "left")
    rows = rows.select("version", "url", "date", "content_type", "content", F.when(F.col("stored") != page, F.col("stored")).alias("same_as"))

    def run(batches):
        def line(_, row):
            version, url, date, content_type, content, same = row
            return to_warc(ArcRecord(version, {"url": url, "date": date, "content_type": content_type}, content), None if same is None else str(same))

        yield from _by_bytes(_lines(_rows(batches), line, None, records, most), RECORD, lambda r: len(r[0]))

    _write_lines(rows.mapInArrow(run, "record binary"), warc_path, "\r\n\r\n", records)
    remove(spark, path)


WARC_ROW = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "target_uri": pa.string(), "record_id": pa.string()}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, record_id of every record."""
    number = lambda x: int(x) if x else None

    def run(batches):
        def records():
            for (raw,) in _rows(batches):
                for w, block in parse_warc(_unpacked(raw)):
                    http, head, body = http_parts(block)
                    kind = w["warc-type"]
                    digest, size = w["warc-payload-digest"].removeprefix("sha256:"), int(http.get("content-length", len(body)))
                    if kind != "revisit" and (hashlib.sha256(body).hexdigest() != digest or len(body) != size):
                        raise ValueError(f"the payload of {w['warc-record-id']} is not as declared")
                    yield number(http.get("x-page-id")), size, digest, kind, number(w.get("warc-refers-to-page")), w["warc-target-uri"], w["warc-record-id"]

        yield from _by_bytes(records(), WARC_ROW, lambda r: 200)

    return _files(spark, path).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, record_id string")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Pages to ARC archives, these to WARC files, and what the WARC files say."""
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    remove(spark, arc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
