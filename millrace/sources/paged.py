"""Sources that follow keys: pages of a table, and pages fetched by a function."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

from millrace.plans.checkpoints import cut


#: Pages whose keys one task holds.
WALKED = 100_000


def paged_table(pages: DataFrame, first_key: Any, max_pages: int = 1_000_000) -> DataFrame:
    """(page_no, item_pos, item) along page_key -> next_key from first_key.

    pages has page_key, items (array) and next_key. The chain ends at a null key, a missing page or an
    empty page; more than max_pages (a cycle) fail. Up to WALKED pages, the chain is walked in one task. Of more pages
    its order is found by doubling: each round joins what is reached with jumps twice as long, so a chain of n pages
    takes log n rounds. Only keys are walked or go through the rounds; items join at the end.
    """
    keys = cut(pages.where(F.size("items") > 0).select("page_key", "next_key"))
    if keys.count() <= WALKED:
        reached = cut(_walked(keys, first_key, max_pages))
        if not reached.where(F.col("page_no") > max_pages).isEmpty():
            raise RuntimeError(f"more than {max_pages} pages from {first_key!r}")
    else:
        reached = _doubled(keys, first_key, max_pages)
    joined = reached.join(pages.select("page_key", "items"), F.col("chain_key") == F.col("page_key"))
    return joined.select("page_no", F.posexplode("items").alias("item_pos", "item"))


def _walked(keys: DataFrame, first_key: Any, max_pages: int) -> DataFrame:
    """(chain_key, page_no) by a walk in one task."""
    kind = keys.schema["page_key"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after: dict[Any, list[Any]] = {}
        type_ = None
        for b in batches:
            type_ = b.column(0).type
            for key, following in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                after.setdefault(key, []).append(following)
        front, found, n = [first_key], [], 0
        while front := [k for k in front if k is not None and k in after]:
            n += 1
            if n > max_pages + 1:
                break
            found += [(k, n) for k in front for _ in after[k]]
            front = [x for k in front for x in after[k]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], type_), pa.array([n for _, n in found], pa.int64())], names=["chain_key", "page_no"])

    return keys.coalesce(1).mapInArrow(walk, f"chain_key {kind}, page_no long")


def _doubled(keys: DataFrame, first_key: Any, max_pages: int) -> DataFrame:
    """(chain_key, page_no) by jumps that double."""
    jump = keys.join(keys.select(F.col("page_key").alias("k")), F.col("next_key") == F.col("k"), "left_semi")
    jump = cut(jump.select(F.col("page_key").alias("a"), F.col("next_key").alias("b")))
    reached = cut(keys.where(F.col("page_key") == F.lit(first_key)).select(F.col("page_key").alias("chain_key"), F.lit(1).cast("long").alias("page_no")))
    length = 1
    while True:
        more = cut(reached.join(jump, F.col("chain_key") == F.col("a")).select(F.col("b").alias("chain_key"), (F.col("page_no") + length).alias("page_no")))
        if more.isEmpty():
            break
        reached = cut(reached.unionAll(more))
        length *= 2
        if length > 2 * max_pages:
            raise RuntimeError(f"more than {max_pages} pages from {first_key!r}")
        jump = cut(jump.join(jump.select(F.col("a").alias("via"), F.col("b").alias("c")), F.col("b") == F.col("via")).select("a", F.col("c").alias("b")))
    return reached


def paged_source(spark: SparkSession, name: str, schema: str, first_key: Any, fetch: Callable[[Any], tuple[list[tuple], Any]]) -> DataFrame:
    """Rows of a Python source that follows keys: fetch(key) = (rows, next key).

    Registered as the data source ``name``; also readable as a stream, a page for each micro-batch.
    Pages are fetched one after another, no further than rows are consumed; None or an empty page ends.
    """

    class Reader(DataSourceReader):
        def read(self, partition: Any) -> Iterator[tuple]:
            key = first_key
            while key is not None:
                rows, key = fetch(key)
                if not rows:
                    return
                yield from rows

    class StreamReader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"key": first_key}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            if start["key"] is None:
                return iter([]), start
            rows, key = fetch(start["key"])
            return iter(list(rows)), {"key": key if rows else None}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            return iter(fetch(start["key"])[0]) if start["key"] is not None else iter([])

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: Any) -> DataSourceReader:
            return Reader()

        def simpleStreamReader(self, schema: Any) -> SimpleDataSourceStreamReader:
            return StreamReader()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()
