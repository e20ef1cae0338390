"""Running sums, maxima and positions over one global order, without a single-partition window.

Sum, count, max, min and "the value before" compose: rows are dealt into ranges of the order key, each range is
scanned on its own, and a table of one row for each range carries what came before it. The ranges'
bounds are a bounded number of approximate quantiles, so the carried table is small by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.checkpoints import cut

RANGES = 256
#: how: (the aggregate, how a carried value and one of the range itself go together)
_SCANS = {
    "sum": (F.sum, lambda c, x: F.coalesce(c + x, c, x)),
    "count": (F.count, lambda c, x: F.coalesce(c, F.lit(0)) + x),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def with_range(df: DataFrame, order_by: str, ranges: int = RANGES) -> DataFrame:
    """df with _range, non-decreasing in a numeric order key; nulls come first."""
    bounds = df.approxQuantile(order_by, [i / ranges for i in range(1, ranges)], 1 / (8 * ranges))
    bounds = sorted(set(bounds or []))
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    return df.withColumn("_range", F.when(F.col(order_by).isNull(), -1).otherwise(F.size(F.filter(edges, lambda b: b <= F.col(order_by)))))


def scan(df: DataFrame, order_by: str, columns: dict[str, tuple[str, Column]], by: Sequence[str] = (), groups: Sequence[str] = ()) -> DataFrame:
    """df with running columns, new name: (how, value), up to and with each row in the order of a unique key.

    how is sum, count, max or min (nulls are left out, all nulls give null or 0), or lag: a struct of the value of
    the row before, null for the first row. With ``by`` each key is a sequence, scanned by one window. Without, the
    whole table is one sequence (or one for each of a bounded number of ``groups``) and its numeric order key is
    dealt into ranges; the table is then written once, since ranges are summed before they are scanned.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(order_by)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({n: F.lag(F.struct(v.alias("value"))).over(w) if how == "lag" else _SCANS[how][0](v).over(upto) for n, (how, v) in columns.items()})
    names = list(df.columns)
    ranged = df.withColumns({f"_v_{n}": F.struct(v.alias("value")) if how == "lag" else v for n, (how, v) in columns.items()})
    ranged = cut(with_range(ranged, order_by))
    keys = ["_range", *groups]
    totals = ranged.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        *[(F.max_by(f"_v_{n}", F.struct(order_by)) if how == "lag" else _SCANS[how][0](f"_v_{n}")).alias(f"_t_{n}") for n, (how, _) in columns.items()]
    )
    before = Window.partitionBy(*[f"_k_{g}" for g in groups]).orderBy("_k__range").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*[f"_k_{k}" for k in keys], *[(F.last(f"_t_{n}", True) if how == "lag" else (F.sum if how == "count" else _SCANS[how][0])(f"_t_{n}")).over(before).alias(f"_c_{n}") for n, (how, _) in columns.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    out = ranged.join(F.broadcast(carry), same)  # at most RANGES + 1 rows for each group
    w = Window.partitionBy(*keys).orderBy(order_by)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = {}
    for n, (how, _) in columns.items():
        own, carried = F.col(f"_v_{n}"), F.col(f"_c_{n}")
        found[n] = F.coalesce(F.lag(own).over(w), carried) if how == "lag" else _SCANS[how][1](carried, _SCANS[how][0](own).over(upto))
    return out.withColumns(found).select(*[n for n in names if n not in columns], *columns)


def global_running(df: DataFrame, order_by: str, sums: dict[str, str] | None = None, position: str | None = None) -> DataFrame:
    """df with running sums (new name: column; nulls count as 0) and a position from 1 in a global order of a unique numeric key."""
    columns = {n: ("sum", F.coalesce(F.col(c), F.lit(0))) for n, c in (sums or {}).items()}
    if position:
        columns[position] = ("count", F.lit(1))
    return scan(df, order_by, columns)
