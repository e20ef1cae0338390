"""Order-dependent operators: running folds, runs, samples, last element."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.stream import Stream, cell
from millrace.plans.prefix import scan

def accumulate(stream: Stream, value: Column | str, zero: Any = None, how: str = "sum", out: str = "acc") -> DataFrame:
    """Running fold; the first output already holds the first element.

    how is sum, max, min or count (associative folds, planned as one window or prefix scan); ``zero`` joins the fold.
    An empty stream gives an empty result.
    """
    value = F.col(value) if isinstance(value, str) else value
    df = stream.scan(**{out: (how, value)}).df
    if zero is None:
        return df
    acc, zero = F.col(out), F.lit(zero)
    return df.withColumn(out, zero + acc if how in ("sum", "count") else (F.greatest if how == "max" else F.least)(zero, acc))


def accumulate_with(stream: Stream, value: str, zero: Any, fold: Callable[[Any, Any], Any], out_type: str, out: str = "acc") -> DataFrame:
    """Running fold by any Python function; rows of a key are one Arrow group in one task."""
    order = stream.order_by

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        acc, held = zero, []
        for x in rows[value]:
            acc = fold(acc, x)
            held.append(acc)
        return rows.assign(**{out: held})

    schema = ", ".join([*(f"`{n}` {t}" for n, t in stream.df.dtypes), f"`{out}` {out_type}"])
    return stream.df.groupBy(*stream.by).applyInPandas(run, schema)


def runs(stream: Stream, unchanged: Column | str, max_duration_us: int | None = None) -> DataFrame:
    """Rows with the number of their run (_run), and their place in it from 0 (_place).

    A run ends where the property changes (nulls are equal) and, with max_duration_us, at each tick of
    the grid of that interval over the arrival times.
    """
    prop = F.col(unchanged) if isinstance(unchanged, str) else unchanged
    df = stream.df.withColumn("_prop", prop)
    parts = ["_prop"]
    if max_duration_us is not None:
        if max_duration_us <= 0 or stream.arrival is None:
            raise ValueError("max_duration_us must be positive and needs arrival times")
        df = df.withColumn("_cell", cell(stream.arrival, max_duration_us))
        parts.append("_cell")
    found = stream.having(df).scan(_before=("lag", F.struct(*parts)), _rn=("count", F.lit(1)))
    changed = F.col("_before").isNull()
    for p in parts:
        changed = changed | ~F.col(p).eqNullSafe(F.col(f"_before.value.{p}"))
    found = found.having(found.df.withColumn("_new", changed.cast("long")))
    found = found.scan(_run=("sum", F.col("_new")), _start=("max", F.when(F.col("_new") == 1, F.col("_rn"))))
    return found.df.withColumn("_place", F.col("_rn") - F.col("_start")).drop("_before", "_rn", "_start")


def accumulate_while_unchanged(stream: Stream, unchanged: Column | str, element: Column | str, max_elements: int | None = None, max_duration_us: int | None = None) -> DataFrame:
    """Batches of successive elements with one property: by, first_order, property, elements, n.

    A batch also ends after max_elements and at ticks of max_duration_us. No batch is empty.
    """
    if max_elements is not None and max_elements < 1:
        raise ValueError("max_elements must be 1 or more")
    element = F.col(element) if isinstance(element, str) else element
    df = runs(stream, unchanged, max_duration_us).withColumn("_element", element)
    chunk = F.expr(f"_place div {max_elements}L") if max_elements else F.lit(0).cast("long")
    held = F.array_sort(F.collect_list(F.struct(F.col(stream.order_by).alias("o"), F.col("_element").alias("e"))))
    grouped = df.groupBy(*stream.by, "_run", chunk.alias("_chunk")).agg(F.min(stream.order_by).alias("first_order"), F.first("_prop").alias("property"), held.alias("_held"))
    return grouped.select(*stream.by, "first_order", "property", F.col("_held.e").alias("elements"), F.size("_held").cast("long").alias("n"))


def sample_nth(stream: Stream, nth: int) -> DataFrame:
    """Elements n, 2n, 3n and so on."""
    if nth < 1:
        raise ValueError("nth must be positive")
    return stream.position("_rn").df.where(F.col("_rn") % nth == 0).drop("_rn")


def sample_steps(stream: Stream, steps: DataFrame) -> DataFrame:
    """Elements at the running sums of a table (step_no, step) of positive steps."""
    bad = F.when(F.col("step").isNull() | (F.col("step") < 1), F.raise_error(F.lit("a sampling step must be positive"))).otherwise(F.col("step"))
    places = scan(steps.select("step_no", bad.cast("long").alias("step")), "step_no", {"_pos": ("sum", F.col("step"))}).select("_pos")
    return stream.position("_rn").df.join(places, F.col("_rn") == F.col("_pos"), "left_semi").drop("_rn")


def sample_random(stream: Stream, max_step: int = 1000, seed: int = 0) -> DataFrame:
    """Elements with gaps that are uniform in 1..max_step, reproducible by seed.

    Gap k is a digest of seed and k. There are no more gaps than positions in the longest key, so the table of gaps comes
    from those, and its running sum is a prefix scan.
    """
    if max_step < 1:
        raise ValueError("max_step must be positive")
    rows = stream.position("_rn").df
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("step_no").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    steps = rows.select(F.col("_rn").alias("step_no")).distinct().withColumn("step", digest % max_step + 1)
    return sample_steps(stream, steps)


def last_element(stream: Stream, value: Iterable[str], ok: str | None = None) -> DataFrame:
    """The last element of each key; with ``ok``, the last before the key's first failure.

    Without keys the result has one row, null for an empty stream.
    """
    df = stream.df
    if ok:
        df = stream.scan(_failed=("max", F.when(~F.col(ok), 1).otherwise(0))).df.where("_failed = 0")
    last = df.groupBy(*stream.by).agg(F.max_by(F.struct(*value), F.col(stream.order_by)).alias("_last"))
    return last.select(*stream.by, *[F.col(f"_last.{v}").alias(v) for v in value])
