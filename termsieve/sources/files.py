"""Binary sources: decoding, gzip snapshots, sitemaps, SVG, images, PDF behind a pluggable reader, fetching.

XML is read with entity declarations refused. Readers return (rows, error) and never raise for bad
input. A worker holds an Arrow batch of files (bounded by the session's bytes and rows a batch, one file at least), and
every cap is a parameter.
"""

from __future__ import annotations

import gzip
import io
import re
import struct
from collections.abc import Callable
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_XML = 50 * 1024 * 1024
MOST_PDF_SEGMENTS = 50_000
FEW_CHARS = 10  # a page with less text needs character recognition
SMALLEST_IMAGE = 48
RASTERS = ("png", "jpeg", "webp")


def decode(body: bytes, content_type: str | None) -> str:
    """By the declared charset, else UTF-8; what cannot be read is replaced."""
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type or "", re.I)
    try:
        return (body or b"").decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def gunzip(body: bytes, most: int) -> bytes:
    """Decompressed where it is gzip; ValueError beyond `most` bytes."""
    if body[:2] != b"\x1f\x8b":
        return body
    with gzip.GzipFile(fileobj=io.BytesIO(body)) as f:
        out = f.read(most + 1)
    if len(out) > most:
        raise ValueError("too large when decompressed")
    return out


def safe_xml(body: bytes) -> ElementTree.Element:
    """Parsed XML; a document that declares entities is refused."""
    guard = expat.ParserCreate()

    def refuse(*_):
        raise ValueError("entity declarations are not allowed")

    guard.EntityDeclHandler = refuse
    guard.Parse(body, True)
    return ElementTree.fromstring(body)


def local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def sitemap(body: bytes) -> tuple[str, list[str]]:
    """(sitemapindex or urlset, locations)."""
    root = safe_xml(gunzip(body, MOST_XML))
    return local(root.tag), [e.text.strip() for e in root.iter() if local(e.tag).endswith("loc") and e.text and e.text.strip()]


def svg_texts(body: bytes) -> list[str]:
    """Text of text, tspan and textPath elements, one entry per outermost text element."""
    root, out = safe_xml(body), []

    def visit(e):
        if local(e.tag) == "text":
            if said := " ".join("".join(e.itertext()).split()):
                out.append(said)
        else:
            for c in e:
                visit(c)

    visit(root)
    return out


def image_size(body: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) from the header of a PNG, GIF, JPEG or WebP; null for others."""
    if body[:8] == b"\x89PNG\r\n\x1a\n" and len(body) >= 24:
        return "png", *struct.unpack(">II", body[16:24])
    if body[:6] in (b"GIF87a", b"GIF89a") and len(body) >= 10:
        return "gif", *struct.unpack("<HH", body[6:10])
    if body[:4] == b"RIFF" and body[8:12] == b"WEBP" and len(body) >= 30:
        if body[12:16] == b"VP8X":
            return "webp", 1 + int.from_bytes(body[24:27], "little"), 1 + int.from_bytes(body[27:30], "little")
        if body[12:16] == b"VP8L":
            b = int.from_bytes(body[21:25], "little")
            return "webp", 1 + (b & 0x3FFF), 1 + (b >> 14 & 0x3FFF)
        return "webp", *(x & 0x3FFF for x in struct.unpack("<HH", body[26:30]))
    if body[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(body) and body[at] == 0xFF:
            mark, size = body[at + 1], int.from_bytes(body[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", body[at + 5 : at + 9])
                return "jpeg", w, h
            at += 2 + size
    return None


def image_outcome(body: bytes | None, most: int = 10 * 1024 * 1024) -> str:
    if body is None:
        return "failed"
    if len(body) > most:
        return "too_large"
    found = image_size(body)
    if found is None:
        return "unreadable"
    kind, w, h = found
    return "too_small" if min(w, h) < SMALLEST_IMAGE else "ok" if kind in RASTERS else "convert"


#: (source, text, page, box) rows of a document, or a reason why there are none.
Reader = Callable[[bytes], tuple[list[tuple], str | None]]


def no_reader(body: bytes) -> tuple[list[tuple], str | None]:
    """Stands in where no PDF library is installed: tells readable from not, reads nothing."""
    if not body.startswith(b"%PDF-"):
        return [], "not readable"
    return [], "password-protected" if b"/Encrypt" in body else "no reader installed"


def document_segments(files: DataFrame, reader: Reader = no_reader, content: str = "content", most: int = MOST_PDF_SEGMENTS) -> DataFrame:
    """One row per segment of each file, or one with the error."""
    kept = [c for c in files.columns if c != content]

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, body in enumerate(batch.column(content)):
                found, error = reader(body.as_py() or b"")
                for k, (source, text, page, box) in enumerate(found[:most]):
                    at.append(i)
                    rows.append((k, source, text, page, box, None))
                if not found:
                    at.append(i)
                    rows.append((None, None, None, None, None, error))
            if at:
                kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.string())
                columns = [batch.column(c).take(pa.array(at, pa.int32())) for c in kept]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*kept, "pos", "text_source", "text", "page", "bbox", "error"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in files.schema.fields if f.name != content)
    return files.select(*kept, content).mapInArrow(run, fields + "pos int, text_source string, text string, page int, bbox array<double>, error string")


def needs_recognition(pages: DataFrame, text: str = "text") -> DataFrame:
    return pages.where(F.char_length(F.trim(F.coalesce(F.col(text), F.lit("")))) < FEW_CHARS)


def sitemap_locations(files: DataFrame, content: str = "content") -> DataFrame:
    """Each file's other columns with kind, loc and pos, or with the error."""
    kept = [c for c in files.columns if c != content]

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, body in enumerate(batch.column(content)):
                try:
                    kind, locs = sitemap(body.as_py() or b"")
                    found = [(kind, loc, k, None) for k, loc in enumerate(locs)] or [(kind, None, None, None)]
                except (ValueError, OSError, EOFError, ElementTree.ParseError, expat.ExpatError) as e:
                    found = [(None, None, None, f"could not parse: {e}")]
                at += [i] * len(found)
                rows += found
            if at:
                kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
                columns = [batch.column(c).take(pa.array(at, pa.int32())) for c in kept]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*kept, "kind", "loc", "pos", "error"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in files.schema.fields if f.name != content)
    return files.select(*kept, content).mapInArrow(run, fields + "kind string, loc string, pos int, error string")


def snapshots(spark: SparkSession, path: str, most: int = MOST_XML) -> DataFrame:
    """(path, html, error) of stored pages, gzip or not."""

    def run(batches):
        for batch in batches:
            html, error = [], []
            for body in batch.column("content"):
                try:
                    html.append(gunzip(body.as_py(), most).decode("utf-8", "replace"))
                    error.append(None)
                except (ValueError, OSError, EOFError) as e:
                    html.append(None)
                    error.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(html, pa.string()), pa.array(error, pa.string())], ["path", "html", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, html string, error string")


def fetched(urls: DataFrame, url: str = "url", most: int = 10 * 1024 * 1024, timeout: float = 20.0, agent: str = "termsieve") -> DataFrame:
    """url, status, headers, final_url, body, truncated, error of each URL; failures are rows."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    def one(address):
        try:
            try:
                reply = urlopen(Request(address, headers={"User-Agent": agent}), timeout=timeout)  # noqa: S310
            except HTTPError as e:
                reply = e
            with reply:
                body = reply.read(most + 1)
                headers = {k.lower(): v for k, v in reply.headers.items()}
                return address, reply.status, list(headers.items()), reply.url, body[:most], len(body) > most, None
        except Exception as e:  # whatever a network does is data here
            return address, None, [], None, None, False, f"{type(e).__name__}: {e}"

    kinds = (pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary(), pa.bool_(), pa.string())
    names = ["url", "status", "headers", "final_url", "body", "truncated", "error"]

    def run(batches):
        for batch in batches:
            for address in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one(address), kinds)], names)

    return urls.select(url).mapInArrow(run, "url string, status int, headers map<string,string>, final_url string, body binary, truncated boolean, error string")


def stored(files: DataFrame, content: str = "content", folder: str = "files", suffix: str = "") -> DataFrame:
    """Content-addressed: each distinct content once, with its digest and place."""
    digest = F.sha2(F.col(content), 256)
    return files.select(digest.alias("digest"), F.col(content).alias("content")).dropDuplicates(["digest"]).withColumn("place", F.concat(F.lit(f"{folder}/"), F.substring("digest", 1, 2), F.lit("/"), "digest", F.lit(suffix)))
