"""WARC archives: writing pages as transactions, reading archives, assembling captures.

A capture is three records: request, response (or revisit, when another page of equal payload keeps
the bytes) and metadata; request and metadata name the response in WARC-Concurrent-To. Archives
are written by Spark's text writer, whose line separator ends the last record of each capture, and
compressed by it, so they land wherever Spark can write; each holds a bounded number of captures and of bytes.
They are read as binary files and parsed by Content-Length in a streaming pass. Assembly joins the
three kinds of records through their identifiers, which carry no payload unless it is asked for.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._scratch import new_path, staged

#: Equal payloads of at least so many bytes are stored once.
MIN_REVISIT_BYTES = 0
#: Captures of an archive, by the bytes of a payload from which the next number holds: at most 256 MB of payloads each,
#: but for a single one that is larger.
CAPTURES_PER_FILE = ((0, 1000), (1 << 18, 16), (1 << 24, 1))
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 18


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    return head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _clean(url: str | None) -> str:
    """A URL as it can stand in a header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def _capture(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """The three records; without the empty line that ends the last."""
    target, digest = _clean(url), base32_sha1(payload)
    response, request, metadata = (f"<urn:uuid:{uuid.uuid4()}>" for _ in range(3))

    def fields(kind: str, name: str, mime: str, *more: tuple[str, str]) -> list[tuple[str, str]]:
        return [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), *([("WARC-Target-URI", target)] if target else []), *more, ("Content-Type", mime)]

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    held = ("WARC-Payload-Digest", f"sha1:{digest}")
    if refers_to is None:
        first = _record(fields("response", response, "application/http; msgtype=response", held), http + payload)
    else:
        first = _record(fields("revisit", response, "application/http; msgtype=response", held, ("WARC-Profile", _PROFILE)), http)
    second = _record(fields("request", request, "application/http; msgtype=request", ("WARC-Concurrent-To", response)), f"GET {target} HTTP/1.1\r\n\r\n".encode())
    notes = "".join(f"{k}: {v}\r\n" for k, v in (("page_id", page_id), ("refers_to", refers_to)) if v is not None)
    third = _record(fields("metadata", metadata, "application/warc-fields", ("WARC-Concurrent-To", response)), notes.encode())
    return b"\r\n\r\n".join((first, second, third)) + b"\r\n"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, date: str = DATE) -> None:
    """Write a capture for each row of pages below ``path``.

    A null html is an empty payload. Of equal payloads of at least ``min_bytes`` the rows with the
    smallest id are responses and all others revisits; so is a row without id, unless no row of that
    payload has one. Payloads are equal if size and SHA-256 are (the SHA-1 of the records decides nothing). Ids are
    integers; rows may repeat; other columns are not read. An empty table gives archives without records.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    groups = keyed.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("n > 1 and least is not null")
    groups = staged(groups.select(F.col("digest").alias("g_digest"), F.col("size").alias("g_size"), "least"), "warc-groups")
    joined = keyed.join(groups.hint("merge"), (F.col("digest") == F.col("g_digest")) & (F.col("size") == F.col("g_size")), "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("least")), F.col("least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([pa.array([_capture(*row, date).decode() for row in zip(*(c.to_pylist() for c in part.columns), strict=True)], pa.string())], names=["value"])

    largest = rows.agg(F.max(F.octet_length("payload"))).first()[0] or 0
    ends = [least for least, _ in CAPTURES_PER_FILE[1:]] + [None]
    for (least, captures_per_file), end in zip(CAPTURES_PER_FILE, ends, strict=True):
        if largest < least:
            break
        part = joined.where(F.col("size") >= least) if end is None else joined.where((F.col("size") >= least) & (F.col("size") < end))
        out = part.select("id", "url", "payload", refers.alias("refers")).mapInArrow(run, "value string")
        out.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", captures_per_file).text(f"{path}/from-{least}")


class _Stream:
    """Bytes of a file, unpacked piece by piece if it is gzip (one or many members)."""

    def __init__(self, content: bytes):
        self.content, self.at, self.buffer = content, 0, b""
        self.packed = content[:2] == b"\x1f\x8b"
        self.unpack = zlib.decompressobj(31) if self.packed else None

    def more(self) -> bool:
        if self.at >= len(self.content):
            return False
        piece = self.content[self.at : self.at + _CHUNK]
        self.at += len(piece)
        if not self.packed:
            self.buffer += piece
            return True
        parts = [self.buffer]
        while piece:
            parts.append(self.unpack.decompress(piece))
            piece = self.unpack.unused_data if self.unpack.eof else b""
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
        self.buffer = b"".join(parts)
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self.more():
                return None
        out, self.buffer = self.buffer[:i], self.buffer[i + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    stream = _Stream(content)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            if not head:
                continue
            raise ValueError(f"not a WARC record: {head[:40]!r}")
        fields = _fields(head)
        yield fields, stream.take(int(fields.get("content-length", 0)))


RECORD = "record_id string, type string, target_uri string, date string, concurrent_to string, payload_bytes long, payload_digest string, notes map<string,string>, payload binary"


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row for each record below ``path``; the digest is computed where the payload is there."""

    def row(fields: dict[str, str], block: bytes) -> tuple:
        kind = fields.get("warc-type")
        size = digest = body = None
        notes = {}
        if kind in ("response", "revisit"):
            head, _, body = block.partition(b"\r\n\r\n")
            if kind == "response":
                size, digest = len(body), base32_sha1(body)
            else:
                size, digest, body = int(_fields(head).get("content-length", 0)), fields.get("warc-payload-digest", "").removeprefix("sha1:"), None
        elif kind == "metadata":
            notes = _fields(block)
        return fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-concurrent-to"), size, digest, list(notes.items()), body if payload else None

    types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse(content.as_py()):
                    rows.append(row(fields, block))
                    if len(rows) >= 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    return files.select("content").mapInArrow(run, RECORD)


def captures(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One nested row for each response or revisit: response, request, metadata.

    request and metadata are null where no record names the response; of several that do, each gives
    a row. Records without identifier are not joined.
    """
    records = staged(read_records(spark, path, payload), "warc-records")
    parts = records.drop("payload").where("concurrent_to is not null")
    responses = records.where("type in ('response', 'revisit')").select(F.struct("record_id", "type", "target_uri", "date", "payload_bytes", "payload_digest", *(["payload"] if payload else [])).alias("response"))
    requests = parts.where("type = 'request'").select(F.struct("record_id", "target_uri", "date", "concurrent_to").alias("request"))
    notes = parts.where("type = 'metadata'").select(F.struct("record_id", "date", "concurrent_to", "notes").alias("metadata"))
    out = responses.join(requests, F.col("response.record_id") == F.col("request.concurrent_to"), "left")
    return out.join(notes, F.col("response.record_id") == F.col("metadata.concurrent_to"), "left")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages written to archives and read back: a row for each page."""
    path = new_path(spark, "warc-archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    note = lambda name: F.element_at("metadata.notes", F.lit(name)).cast("long")
    return captures(spark, path).select(
        note("page_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(F.col("response.type") == "revisit", note("refers_to")).alias("refers_to"),
    )


OP6_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS least FROM p),
v AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, 1 + 5 * i, 5) AS BIGINT)) AS q FROM f)
SELECT page_id, octet_length(body) AS payload_bytes,
       array_to_string(list_transform(q, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> 15) & 31 AS INT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> 10) & 31 AS INT) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> 5) & 31 AS INT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x & 31 AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM v
"""
