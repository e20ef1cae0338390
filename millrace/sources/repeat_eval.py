"""A source that evaluates an expression again and again until it is cancelled."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def repeat_eval(spark: SparkSession, n: int, value: Column | Callable[[], Any], value_type: str = "string", out: str = "value") -> DataFrame:
    """n evaluations, each of its own: a column expression, or a Python function (evaluated in the tasks)."""
    ids = spark.range(n)
    if isinstance(value, Column):
        return ids.select(F.col("id").alias("n"), value.alias(out))

    def run(batches):
        for b in batches:
            yield b.assign(**{out: [value() for _ in range(len(b))]}).rename(columns={"id": "n"})

    return ids.mapInPandas(run, f"n long, {out} {value_type}")


class Cancellable:
    """A running stream of evaluations; cancel() is true for the call that stopped it."""

    def __init__(self, query: StreamingQuery):
        self.query, self._lock, self._cancelled = query, threading.Lock(), False

    def cancel(self) -> bool:
        with self._lock:
            if self._cancelled:
                return False
            self._cancelled = True
        self.query.stop()
        return True

    @property
    def is_cancelled(self) -> bool:
        return self._cancelled


def repeat_eval_stream(spark: SparkSession, value: Column, rows_per_second: int, start: Callable[[DataFrame], StreamingQuery], out: str = "value") -> Cancellable:
    """Start an endless stream of evaluations with ``start(df)`` and give its handle."""
    source = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return Cancellable(start(source.select(F.col("value").alias("n"), value.alias(out))))
