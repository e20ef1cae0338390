"""Changes of a directory, and the growing tail of a file."""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

CHUNK_BYTES = 8192
#: Bytes of a growing file that a micro-batch takes at most; they pass through the driver.
BATCH_BYTES = 16 << 20


def directory_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two listings (path, mtime_us, size): Creation, Modification, Deletion."""
    b = before.select(F.col("path").alias("b_path"), F.col("mtime_us").alias("b_time"), F.col("size").alias("b_size"))
    joined = after.select("path", "mtime_us", "size").join(b, F.col("path") == F.col("b_path"), "full")
    changed = ~(F.col("mtime_us").eqNullSafe(F.col("b_time")) & F.col("size").eqNullSafe(F.col("b_size")))
    change = F.when(F.col("b_path").isNull(), "Creation").when(F.col("path").isNull(), "Deletion").when(changed, "Modification")
    return joined.select(F.coalesce("path", "b_path").alias("path"), change.alias("change")).where("change is not null")


def _listing(path: str) -> dict[str, list[int]]:
    out = {}
    for e in os.scandir(path):
        s = e.stat()
        out[e.path] = [s.st_mtime_ns // 1000, s.st_size]
    return out


def changes_between(before: dict[str, list[int]], after: dict[str, list[int]]) -> list[tuple[str, str]]:
    out = [(p, "Creation") for p in after if p not in before]
    out += [(p, "Modification") for p in after if p in before and before[p] != after[p]]
    return sorted(out) + sorted((p, "Deletion") for p in before if p not in after)


class _Directory(SimpleDataSourceStreamReader):
    """Offsets are whole listings, so a batch can be replayed from the checkpoint."""

    def __init__(self, path: str, limit: int):
        self.path, self.limit = path, limit

    def initialOffset(self) -> dict:
        return {"listing": _listing(self.path)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = _listing(self.path) if os.path.isdir(self.path) else {}
        found = changes_between(start["listing"], now)
        if len(found) > self.limit:
            raise OverflowError(f"{len(found)} changes; the buffer holds {self.limit}")
        return iter(found), {"listing": now}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(changes_between(start["listing"], end["listing"]))


class DirectoryChanges(DataSource):
    """Stream source ``directory_changes``: options path and maxBufferSize; one directory, not its children."""

    @classmethod
    def name(cls) -> str:
        return "directory_changes"

    def schema(self) -> str:
        return "path string, change string"

    def simpleStreamReader(self, schema: Any) -> SimpleDataSourceStreamReader:
        path = self.options["path"]
        if not os.path.isdir(path):
            raise ValueError(f"{path} is not a directory")
        return _Directory(path, int(self.options.get("maxBufferSize", 1000)))


def _chunks(path: str, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    with open(path, "rb") as f:
        f.seek(start)
        while start < end and (chunk := f.read(min(size, end - start))):
            yield start, chunk
            start += len(chunk)


class _TailStream(SimpleDataSourceStreamReader):
    def __init__(self, path: str, start: int, size: int, most: int):
        self.path, self.start, self.size = path, start, size
        self.most = max(most // size, 1) * size  # whole chunks

    def initialOffset(self) -> dict:
        return {"at": self.start}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = max(start["at"], min(os.path.getsize(self.path), start["at"] + self.most))
        return iter(list(_chunks(self.path, start["at"], end, self.size))), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return _chunks(self.path, start["at"], end["at"], self.size)


class _TailBatch(DataSourceReader):
    def __init__(self, path: str, start: int, size: int):
        self.path, self.start, self.size = path, start, size

    def read(self, partition: Any) -> Iterator[tuple]:
        return _chunks(self.path, self.start, os.path.getsize(self.path), self.size)


class FileTail(DataSource):
    """Source ``file_tail``: options path, startPosition, maxChunkSize and maxBatchBytes; (position, chunk).

    As a batch what is there now, as a stream also what is appended, at most maxBatchBytes in a micro-batch; offsets
    are byte positions.
    """

    @classmethod
    def name(cls) -> str:
        return "file_tail"

    def schema(self) -> str:
        return "position long, chunk binary"

    def _options(self) -> tuple[str, int, int]:
        path = self.options["path"]
        if not os.path.exists(path) or os.path.isdir(path) or not os.access(path, os.R_OK):
            raise ValueError(f"{path} is not a readable file")
        size = int(self.options.get("maxChunkSize", CHUNK_BYTES))
        if size < 1:
            raise ValueError("maxChunkSize must be positive")
        return path, int(self.options.get("startPosition", 0)), size

    def reader(self, schema: Any) -> DataSourceReader:
        return _TailBatch(*self._options())

    def simpleStreamReader(self, schema: Any) -> SimpleDataSourceStreamReader:
        return _TailStream(*self._options(), int(self.options.get("maxBatchBytes", BATCH_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the sources known to a session."""
    spark.dataSource.register(DirectoryChanges)
    spark.dataSource.register(FileTail)


def byte_chunks(files: DataFrame, key: str, content: str, start: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(key, position, chunk) of a binary column from a start position, on the JVM."""
    n = F.octet_length(content)
    starts = F.when(n > start, F.sequence(F.lit(start), n - 1, F.lit(chunk_bytes))).otherwise(F.array().cast("array<int>"))
    rows = files.select(key, content, F.explode(starts).alias("position"))
    return rows.select(key, F.col("position").cast("long").alias("position"), F.substring(F.col(content), F.col("position") + 1, F.lit(chunk_bytes)).alias("chunk"))
