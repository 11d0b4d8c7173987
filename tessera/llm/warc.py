"""Legacy archive converter: ARC files become WARC files.

An ARC file begins with a version block (`filedesc://`) whose second line names
its version. Version 1 header lines have 5 fields, version 2 lines have 10; the
last is the length of the content that follows, which is the only thing that
ends a record (contents may hold anything). A URL may hold blanks: fields are
counted from the right.

For each record the converter synthesises what WARC asks for and ARC lacks: a
record id (a UUID from archive and offset, so that a repeated run gives the
same), a WARC-Date from the 14-digit date, a type, and SHA-1 digests of block
and payload. Contents that begin with `HTTP/` become response records, others
resource records.

Payloads of at least `min_revisit` bytes that several records share are written once: the
record of the largest page id is the response, the others are revisit records
that name it by record id, address and page, and hold the HTTP header alone. Smaller ones are all responses. Only
ids and hashes are shuffled to find them; the decisions travel to the records
when they are few (their number is counted first), and are joined otherwise.

WARC files are written by Spark's text sink as `\\r\\n\\r\\n`-ended records, which is
just how WARC ends a record, so that any file system and Spark's own commit
protocol work; they are read back as binary files, record by record, by the
declared Content-Length.

Defined results: null html is an empty payload; repeated rows with the largest
page id are responses all; a null page id counts as smaller than any, and where
all are null all are responses; a null url is `about:blank`; other columns are
ignored. A record that its archive cuts short raises ValueError.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, scratch_path, stash, table

MIN_REVISIT = 1000
#: Bytes of one archive that pages are packed into, about.
ARC_BYTES = 4 << 20
#: Revisit decisions up to this number travel to the tasks that write.
MAP_SIDE_REVISITS = 200_000
#: Records of one WARC file at most.
FILE_RECORDS = 5_000

_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_DATE = "20260101000000"


def arc_version_block(name: str, version: int) -> bytes:
    body = b"%d 0 tessera\n%s\n\n" % (version, _FIELDS[version])
    extra = b"" if version == 1 else b" 200 - - 0 " + name.encode()
    return b"filedesc://%s 0.0.0.0 %s text/plain%s %d\n%s" % (name.encode(), _DATE.encode(), extra, len(body), body)


def arc_record(version: int, url: bytes, content: bytes, mime: bytes, name: str, offset: int, date: str = _DATE) -> bytes:
    extra = b"" if version == 1 else b" 200 %s - %d %s" % (hashlib.md5(content).hexdigest().encode(), offset, name.encode())
    return b"%s 0.0.0.0 %s %s%s %d\n%s\n" % (url, date.encode(), mime, extra, len(content), content)


def parse_arc(archive: bytes) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """(offset, url, date, mime, content) of each record after the version block."""
    at, fields = 0, 0
    while at < len(archive):
        if archive[at : at + 1] in b"\r\n":  # what separates records
            at += 1
            continue
        end = archive.find(b"\n", at)
        line = archive[at : end if end >= 0 else len(archive)].rstrip(b"\r")
        if not fields:
            length = int(line.rsplit(b" ", 1)[1])
            body = archive[end + 1 : end + 1 + length]
            version = int(body.split(b" ", 1)[0]) if line.startswith(b"filedesc:") else 0
            if version not in _FIELDS:
                raise ValueError(f"not an ARC file of a known version: {line[:80]!r}")
            fields = len(_FIELDS[version].split())
        else:
            parts = line.rsplit(b" ", fields - 1)
            if len(parts) != fields or not parts[-1].isdigit():
                raise ValueError(f"bad ARC header line at {at}: {line[:80]!r}")
            length = int(parts[-1])
            content = archive[end + 1 : end + 1 + length]
            if end < 0 or len(content) != length:
                raise ValueError(f"the record at {at} is cut short")
            yield at, parts[0], parts[2], parts[3], content
        at = end + 1 + length


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """(HTTP header with its blank line, payload); a content without one is all payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content, b"") if end < 0 else (content[: end + 4], content[end + 4 :])


def sha1_32(data: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(hashlib.sha1(data).digest())


def record_id(name: str, offset: int) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{offset}"))


def warc_record(kind: str, rid: str, url: bytes, date: bytes, mime: bytes, head: bytes, payload: bytes, refers: tuple[str, int, bytes] | None = None) -> bytes:
    """A WARC record without the two line ends that close it."""
    d = date.decode().ljust(14, "0")
    block = head if kind == "revisit" else head + payload
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:uuid:" + rid.encode() + b">", f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z".encode(), b"WARC-Target-URI: " + url]
    if refers:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:uuid:" + refers[0].encode() + b">", b"WARC-Refers-To-Target-URI: " + refers[2], b"WARC-Refers-To-Page: %d" % refers[1]]
    lines += [b"WARC-Payload-Digest: " + sha1_32(payload), b"WARC-Payload-Length: %d" % len(payload), b"WARC-Block-Digest: " + sha1_32(block)]
    lines += [b"Content-Type: " + (b"application/http; msgtype=response" if head else mime), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record, by declared lengths."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("the record is cut short")
        yield headers, block


_ARC = "name string, content binary"
_PARSED = "rid string, page_id long, url binary, date binary, mime binary, head binary, payload binary, bytes long, key binary"
_OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def pages_to_arc(pages: DataFrame, arc_bytes: int = ARC_BYTES) -> DataFrame:
    """(name, content): the pages in ARC archives of both versions, by turns. The page id goes in an HTTP header."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        name, version, out, size = "", 1, [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)], pa.binary())], ["name", "content"])

        for batch in batches:
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not out:
                    name, version = f"part-{part:06d}-{n:06d}.arc", 1 + (part + n) % 2
                    out, n = [arc_version_block(name, version)], n + 1
                    size = len(out[0])
                payload = (html or "").encode("utf-8", "surrogatepass")
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if page is None else b"X-Page-Id: %d\r\n" % page) + b"Content-Length: %d\r\n\r\n" % len(payload)
                link = re.sub(rb"[\x00-\x1f\x7f]", lambda m: b"%%%02X" % m[0][0], ("about:blank" if url is None else url).encode("utf-8", "surrogatepass"))
                out.append(arc_record(version, link, head + payload, b"text/html", name, size))
                size += len(out[-1])
                if size >= arc_bytes:
                    yield done()
                    out = []
        if out:
            yield done()

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(pack, _ARC)


def read_arc(archives: DataFrame) -> DataFrame:
    """Records of archives (name, content), with HTTP header and payload apart."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PARSED.split(", ")]
        types = [pa.string(), pa.int64(), *[pa.binary()] * 5, pa.int64(), pa.binary()]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                for offset, url, date, mime, body in parse_arc(content.as_py()):
                    head, payload = split_http(body)
                    page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
                    rows.append((record_id(name, offset), int(page[1]) if page else None, url, date, mime, head, payload, len(payload), hashlib.sha256(payload).digest()))
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return archives.mapInArrow(parse, _PARSED)


def revisits(records: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(rid, refers_to, refers_rid, refers_url) of the records that revisit another, from ids, addresses and hashes alone."""
    large = cut(records.where(F.col("bytes") >= min_revisit).select("rid", "page_id", "url", "key"))
    shared = large.groupBy("key").agg(F.max(F.struct("page_id", "rid", "url")).alias("top"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("top.page_id").isNotNull())
    shared = cut(shared.select("key", F.col("top.page_id").alias("refers_to"), F.col("top.rid").alias("refers_rid"), F.col("top.url").alias("refers_url")))
    return large.select("rid", "page_id", "key").join(shared, "key").where(F.coalesce(F.col("page_id") < F.col("refers_to"), F.lit(True))).select("rid", "refers_to", "refers_rid", "refers_url")


def arc_to_warc(archives: DataFrame, path: str, min_revisit: int = MIN_REVISIT, map_side: int = MAP_SIDE_REVISITS) -> None:
    """Convert archives (name, content) to gzipped WARC files below path."""
    records = read_arc(archives)
    again = cut(revisits(records, min_revisit))
    few = again.count() <= map_side  # about 200 bytes each
    records = records.drop("bytes", "key").join(F.broadcast(again) if few else again, "rid", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
        first = warc_record("warcinfo", record_id("info", TaskContext.get().partitionId()), b"urn:tessera", _DATE.encode(), b"application/warc-fields", b"", info)
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.binary())], ["record"])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                refers = None if r["refers_to"] is None else (r["refers_rid"], r["refers_to"], r["refers_url"])
                kind = "revisit" if refers else "response" if r["head"] else "resource"
                out.append(warc_record(kind, r["rid"], r["url"], r["date"], r["mime"], r["head"], r["payload"], refers))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = records.mapInArrow(write, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", FILE_RECORDS).option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per record of the WARC files below path (warcinfo aside): the page, its payload's size and digest, and what it refers to."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _OUT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))
                rows: list[tuple] = []
                for headers, block in parse_warc(stream):
                    kind = headers["warc-type"]
                    if kind == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
                    if kind == "revisit":
                        size, digest = int(headers["warc-payload-length"]), base64.b32decode(headers["warc-payload-digest"][5:])
                    else:
                        size, digest = len(payload), hashlib.sha1(payload).digest()
                        if b"sha1:" + base64.b32encode(digest) != headers["warc-payload-digest"].encode():
                            raise ValueError(f"digest of {headers['warc-record-id']} does not fit its payload")
                    refers = headers.get("warc-refers-to-page")
                    rows.append((int(page[1]) if page else None, size, digest.hex(), kind, None if refers is None else int(refers)))
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(parse, _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    arc_to_warc(stash(pages_to_arc(table(spark, sf_dir, "pages")), "arc"), path)  # the archives are there before the conversion begins
    return read_warc(spark, path)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN top IS NOT NULL AND (page_id IS NULL OR page_id < top) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS NULL OR page_id < top THEN top END AS refers_to
FROM p LEFT JOIN m ON p.h = m.h
"""
