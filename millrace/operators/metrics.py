"""Time measured: whole streams, intervals between matches, latency through a flow."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.stream import Stream


def timed(stream: Stream, time_us: str | None = None) -> DataFrame:
    """by, duration_us from the first to the last element; null for an empty stream (without keys)."""
    t = F.col(time_us or stream.arrival)
    return stream.df.groupBy(*stream.by).agg((F.max(t) - F.min(t)).alias("duration_us"), F.count(F.lit(1)).alias("n"))


def timed_action(action: Callable[[], Any], on_complete: Callable[[float], None]) -> Any:
    """The action's result; its wall-clock seconds go to on_complete, after a failure, too."""
    start = time.perf_counter()
    try:
        return action()
    finally:
        on_complete(time.perf_counter() - start)


def timed_interval_between(stream: Stream, matching: Column, time_us: str | None = None) -> DataFrame:
    """The matching rows but each key's first, with interval_us since the match before."""
    t = F.col(time_us or stream.arrival)
    found = stream.having(stream.df.where(matching)).scan(_last=("lag", t)).df
    return found.withColumn("interval_us", t - F.col("_last.value")).where("interval_us is not null").drop("_last")


def measure_latency(stream: Stream, flow: Callable[[Stream], DataFrame], key: str, left_us: str = "emit_us", to: Callable[[DataFrame], Any] | None = None) -> DataFrame:
    """The flow's rows with latency_us, from the arrival of the element of the same ``key`` until it left the flow.

    flow gives rows with the key and, in ``left_us``, when they left. Elements that the flow drops have no latency; rows
    that the flow makes of no element have a null one. With ``to`` the latencies, (key, latency_us) of those that have
    one, go there (a sink, an aggregation) and the flow's rows come back unchanged.
    """
    if stream.arrival is None:
        raise ValueError("the operator needs arrival times")
    out = flow(stream)
    came = stream.df.select(F.col(key).alias("_k"), F.col(stream.arrival).alias("_came"))
    measured = out.join(came, F.col(key) == F.col("_k"), "left").withColumn("latency_us", F.col(left_us) - F.col("_came")).drop("_k", "_came")
    if to is None:
        return measured
    to(measured.where("latency_us is not null").select(key, "latency_us"))
    return out


def map_measured(df: DataFrame, value: str, function: Callable[[Any], Any], result_type: str, out: str = "result") -> DataFrame:
    """df with the function's result for each element and latency_us, the wall-clock time of its call in the task.

    A null result drops the element; its time is not reported.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results, took = [], []
            for x in batch[value].tolist():
                start = time.perf_counter_ns()
                results.append(function(x))
                took.append((time.perf_counter_ns() - start) // 1000)
            found = batch.assign(**{out: pd.Series(results, index=batch.index, dtype=object), "latency_us": took})
            yield found[[r is not None for r in results]]

    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), f"`{out}` {result_type}, latency_us long"])
    return df.mapInPandas(run, schema)


def latency_timer(starts: DataFrame, ends: DataFrame, by: list[str], start_us: str, end_us: str, strict: bool = False) -> DataFrame:
    """ends with started_us (the last start at or before) and latency_us; ends without a start are absent.

    As-of pairing by one union and one window. With strict, two ends of one start fail.
    """
    s = starts.select(*by, F.col(start_us).cast("long").alias("_t"), F.lit(0).alias("_side"))
    e = ends.withColumn("_t", F.col(end_us).cast("long")).withColumn("_side", F.lit(1))
    both = e.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_t", "_side")
    last = F.max(F.when(F.col("_side") == 0, F.col("_t"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = both.withColumn("started_us", last)
    if strict:
        both = both.withColumn("_before", F.lag("_side").over(w))
        both = both.withColumn("started_us", F.when((F.col("_side") == 1) & (F.col("_before") == 1), F.raise_error(F.lit("an output without an input of its own"))).otherwise(F.col("started_us")))
    out = both.where("_side = 1 and started_us is not null").withColumn("latency_us", F.col("_t") - F.col("started_us"))
    return out.drop("_t", "_side", "_before")
