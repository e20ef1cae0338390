"""Chunks of the files in zip archives, nested archives included."""

from __future__ import annotations

import calendar
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 8192
EXTENSIONS = (".zip",)
SCHEMA = "archive string, name string, creation_ms long, chunk_no long, chunk binary"


def entries(content: bytes | io.BufferedIOBase, chunk_bytes: int = CHUNK_BYTES, extensions: tuple[str, ...] = EXTENSIONS) -> Iterator[tuple[str, int, int, bytes]]:
    """(name, creation_ms, chunk_no, chunk) of each file; entries whose lower-case name ends with an extension are opened."""
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as archive:
        for info in archive.infolist():
            if info.is_dir():
                continue
            with archive.open(info) as file:
                if info.filename.lower().endswith(extensions):
                    yield from entries(file.read(), chunk_bytes, extensions)
                    continue
                made = calendar.timegm((*info.date_time, 0, 0, 0)) * 1000
                number = 0
                while chunk := file.read(chunk_bytes):
                    yield info.filename, made, number, chunk
                    number += 1


def zip_entries(files: DataFrame, chunk_bytes: int = CHUNK_BYTES, extensions: tuple[str, ...] = EXTENSIONS, path: str = "path", content: str = "content") -> DataFrame:
    """SCHEMA for a table of archives (path, content), as ``binaryFile`` gives it.

    Directories and empty files give no chunk; chunks do not span files, the last may be short. A
    null content gives nothing; a broken archive fails the query.
    """
    if chunk_bytes < 1:
        raise ValueError("chunk_bytes must be positive")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, body in zip(b.column(0), b.column(1), strict=True):
                if not body.is_valid:
                    continue
                rows, size = [], 0
                for row in entries(body.as_py(), chunk_bytes, tuple(extensions)):
                    rows.append((where.as_py(), *row))
                    size += len(row[3])
                    if size > 1 << 22:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return files.select(path, content).mapInArrow(run, SCHEMA)


def total_bytes(chunks: DataFrame) -> DataFrame:
    """(archive, total_bytes): what the source has read of each archive, unpacked; archives without a chunk are absent."""
    return chunks.groupBy("archive").agg(F.sum(F.octet_length("chunk").cast("long")).alias("total_bytes"))


def zip_source(spark: SparkSession, path: str, **options) -> DataFrame:
    """zip_entries of all files below a path of any store that Spark reads."""
    return zip_entries(spark.read.format("binaryFile").load(path), **options)
