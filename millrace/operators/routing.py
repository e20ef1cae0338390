"""Operators with several inputs or outputs: either-partitioning, positional pass-through, index merge."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.prefix import global_running, scan


def partition_with(df: DataFrame, left_if: Column, left: Sequence[Column], right: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """Two outputs of different types: rows where left_if holds, transformed, and the rest, transformed.

    A row whose condition is null goes right. Both outputs read the input once each; cache it if it is dear.
    """
    is_left = F.coalesce(left_if, F.lit(False))
    return df.where(is_left).select(*left), df.where(~is_left).select(*right)


def either(df: DataFrame, left_if: Column, left: Column, right: Column) -> DataFrame:
    """One column ``either`` of struct (side, left, right) instead of two outputs."""
    is_left = F.coalesce(left_if, F.lit(False))
    return df.withColumn("either", F.struct(F.when(is_left, "left").otherwise("right").alias("side"), F.when(is_left, left).alias("left"), F.when(~is_left, right).alias("right")))


def divert_to(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that go on, and rows that are diverted (where the condition holds)."""
    taken = F.coalesce(condition, F.lit(False))
    return df.where(~taken), df.where(taken)


def pass_through(df: DataFrame, flow: Callable[[DataFrame], DataFrame], key: str, result: str, out: str = "result") -> DataFrame:
    """Each row with the flow's result for it.

    flow gets df and returns one row for each, with ``key`` (unique in df) and ``result``; a flow that
    loses or repeats rows fails the query.
    """
    inner = flow(df).select(F.col(key).alias("_k"), F.col(result).alias("_r"))
    inner = inner.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.first("_r").alias("_r"))
    joined = df.join(inner, df[key].eqNullSafe(F.col("_k")), "left")
    checked = F.when(F.coalesce("_n", F.lit(0)) != 1, F.raise_error(F.lit("the flow must return one row for each row"))).otherwise(F.col("_r"))
    return joined.withColumn(out, checked).drop("_k", "_n", "_r")


def zip_by_position(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Pairs of rows of equal position; the longer side's rest is dropped."""
    x = global_running(left, left_order, position="_p")
    y = global_running(right, right_order, position="_q")
    return x.join(y, F.col("_p") == F.col("_q")).drop("_p", "_q")


def merge_by_index(inputs: Sequence[DataFrame], index: str, order_by: str) -> DataFrame:
    """The rows of all inputs in the order of their index, with emit_position from 1.

    Gaps are fine. Fails if an index is negative or null, repeats, or does not rise within an input (in
    the order of order_by).
    """
    if not inputs:
        raise ValueError("at least one input is needed")
    parts = [df.withColumn("_input", F.lit(i)) for i, df in enumerate(inputs)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    # Within an input: after the index before. Inputs are few; their order is dealt into ranges, too.
    union = scan(union, order_by, {"_last": ("lag", F.col(index))}, groups=["_input"])
    bad = F.col(index).isNull() | (F.col(index) < 0) | (F.col("_last.value") >= F.col(index))
    union = union.withColumn("_ok", F.when(bad, F.raise_error(F.lit("the index of an input must rise from 0 or more"))).otherwise(F.lit(True)))
    # Equal indexes are neighbours in the global order.
    merged = scan(union, index, {"emit_position": ("count", F.lit(1)), "_last": ("lag", F.col(index))})
    twice = F.col("_last.value") == F.col(index)
    merged = merged.withColumn("_once", F.when(twice, F.raise_error(F.lit("an index occurs twice"))).otherwise(F.lit(True)))
    return merged.where("_ok and _once").drop("_input", "_last", "_ok", "_once")


def flattened(df: DataFrame, items: str, out: str = "item") -> DataFrame:
    """A row for each item of an array column, with its position from 0."""
    return df.select(*[c for c in df.columns if c != items], F.posexplode(items).alias("item_pos", out))


def concatenated(first: DataFrame, second: DataFrame, order_by: str) -> DataFrame:
    """All rows of first, then all of second: the order column becomes (part, order)."""
    return first.withColumn("part", F.lit(0)).unionByName(second.withColumn("part", F.lit(1))).withColumn("sequence", F.struct("part", order_by))
