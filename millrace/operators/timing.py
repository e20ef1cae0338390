"""Flow control in replay: which elements leave when, in microseconds since the stream's start.

Every operator but the state machines has a closed form over running sums and maxima, so a key costs one
shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.stream import Stream, cell


def _arrivals(stream: Stream) -> str:
    if stream.arrival is None:
        raise ValueError("the operator needs arrival times")
    return stream.arrival


def delay_by(stream: Stream, delay_us: Column | str, out: str = "emit_us") -> DataFrame:
    """Serial delay: an element leaves delay_us after it arrived or its predecessor left.

    Delays below zero count as zero, nulls too.
    """
    a = F.col(_arrivals(stream))
    d = F.col(delay_us) if isinstance(delay_us, str) else delay_us
    df = stream.df.withColumn("_d", F.greatest(F.coalesce(d, F.lit(0)).cast("long"), F.lit(0)))
    found = stream.having(df).scan(_sum=("sum", F.col("_d")))
    found = found.scan(_late=("max", a - (F.col("_sum") - F.col("_d"))))
    return found.df.withColumn(out, F.col("_sum") + F.col("_late")).drop("_d", "_sum", "_late")


def delay_fixed(stream: Stream, delay_us: int, out: str = "emit_us") -> DataFrame:
    """A constant delay; zero or less passes everything at once."""
    if delay_us <= 0:
        return stream.df.withColumn(out, F.col(_arrivals(stream)))
    return delay_by(stream, F.lit(delay_us), out)


def delay_linear(stream: Stream, step_us: int, grows: Column | str, initial_us: int = 0, max_us: int | None = None, out: str = "emit_us") -> DataFrame:
    """A delay that grows by step_us with each successive true of ``grows``, and falls back on false."""
    if step_us <= 0 or (max_us is not None and max_us <= initial_us):
        raise ValueError("step_us must be positive and max_us above initial_us")
    flag = F.coalesce(F.col(grows) if isinstance(grows, str) else grows, F.lit(False))
    found = stream.having(stream.df.withColumn("_flag", flag.cast("long"))).scan(_trues=("sum", F.col("_flag")))
    found = found.scan(_reset=("max", F.when(F.col("_flag") == 0, F.col("_trues"))))
    d = initial_us + (F.col("_trues") - F.coalesce("_reset", F.lit(0))) * step_us
    d = F.least(d, F.lit(max_us)) if max_us is not None else d
    df = found.df.withColumn("delay_us", F.when(F.col("_flag") == 1, d).otherwise(F.lit(initial_us)).cast("long"))
    return delay_by(stream.having(df), "delay_us", out).drop("_flag", "_trues", "_reset")


def delay_strategy(stream: Stream, strategy: Callable[[], Callable[[dict], int]], out: str = "emit_us") -> DataFrame:
    """Delays from a stateful object, made anew for each key: next_delay(row) gives microseconds."""
    arrival, order = _arrivals(stream), stream.order_by

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        next_delay, left, held = strategy(), None, []
        for row in rows.to_dict("records"):
            a = int(row[arrival])
            left = (a if left is None else max(left, a)) + max(0, int(next_delay(row)))
            held.append(left)
        return rows.assign(**{out: held})

    schema = ", ".join([*(f"`{n}` {t}" for n, t in stream.df.dtypes), f"`{out}` long"])
    return stream.df.groupBy(*stream.by).applyInPandas(run, schema)


def pulse(stream: Stream, interval_us: int, initially_open: bool = False, out: str = "emit_us") -> DataFrame:
    """One element a tick, none lost; initially open, the first passes at once."""
    a = F.col(_arrivals(stream))
    found = stream.position("_rn")
    found = found.scan(_late=("max", cell(stream.arrival, interval_us) - F.col("_rn")))
    tick = F.col("_rn") + F.greatest(F.col("_late"), F.lit(-1 if initially_open else 0))
    return found.df.withColumn(out, F.greatest(a, tick * interval_us)).drop("_rn", "_late")


def time_window_tumbling(df: DataFrame, ts: str, by: list[str], width: str, **aggregates: Column) -> DataFrame:
    """Aggregates of tumbling windows of event time; windows without elements give no row."""
    grouped = df.groupBy(*by, F.window(ts, width).alias("_w")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(*by, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *aggregates)


def time_window(stream: Stream, interval_us: int, eager: bool = True) -> DataFrame:
    """Rows with their batch as a pulsed conflating buffer forms it: _cell, alone (0/1) and emit_us.

    Where downstream already waits, the first element of a cell leaves alone and at once; all others of
    the cell leave together at its end. Rows of one (by, _cell, alone) are a batch.
    """
    _arrivals(stream)
    by = list(stream.by)
    x = stream.df.withColumn("_cell", cell(stream.arrival, interval_us))
    w = Window.partitionBy(*by).orderBy("_cell")
    k = x.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before, count = F.lag("_cell").over(w), F.lag("_n").over(w)
    decided = F.when(before.isNull(), F.when(F.col("_cell") == 0, F.lit(int(eager))).otherwise(1)).when(F.col("_cell") > before + 1, 1).when(count >= 2, 0)
    k = k.withColumn("_decided", decided)
    k = k.withColumn("_group", F.count("_decided").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    k = k.withColumn("_armed", F.max("_decided").over(Window.partitionBy(*by, "_group")))
    y = x.join(k.select(*by, "_cell", "_armed"), [*by, "_cell"])
    place = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(stream.order_by))
    y = y.withColumn("alone", ((F.col("_armed") == 1) & (place == 1)).cast("long"))
    emit = F.when(F.col("alone") == 1, F.col(stream.arrival)).otherwise((F.col("_cell") + 1) * interval_us)
    return y.withColumn("emit_us", emit).drop("_armed")


def grouped_within(stream: Stream, max_elements: int, interval_us: int, element: Column | str) -> DataFrame:
    """Batches that close at max_elements or at the grid's next tick: by, first_order, elements, n, ready_us."""
    if max_elements < 1 or interval_us < 1:
        raise ValueError("max_elements and interval_us must be positive")
    _arrivals(stream)
    element = F.col(element) if isinstance(element, str) else element
    df = stream.df.withColumn("_cell", cell(stream.arrival, interval_us)).withColumn("_element", element)
    place = F.row_number().over(stream.window("_cell")) - 1
    df = df.withColumn("_place", place.cast("long")).withColumn("_chunk", F.expr(f"_place div {max_elements}L"))
    held = F.array_sort(F.collect_list(F.struct(F.col(stream.order_by).alias("o"), F.col("_element").alias("e"))))
    g = df.groupBy(*stream.by, "_cell", "_chunk").agg(F.min(stream.order_by).alias("first_order"), held.alias("_held"), F.max(stream.arrival).alias("_last"))
    n = F.size("_held").cast("long")
    ready = F.when(n == max_elements, F.col("_last")).otherwise((F.col("_cell") + 1) * interval_us)
    return g.select(*stream.by, "first_order", F.col("_held.e").alias("elements"), n.alias("n"), ready.alias("ready_us"))


def interval_rate_limiter(stream: Stream, min_interval_us: int, max_batch: int, element: Column | str) -> DataFrame:
    """Batches of at most max_batch that leave min_interval_us apart or more: order and all elements kept."""
    batches = grouped_within(stream, max_batch, min_interval_us, element)
    return delay_fixed(Stream(batches, "first_order", tuple(stream.by), "ready_us"), min_interval_us)


def token_throttle(stream: Stream, cost: Column | str, grants: DataFrame, amount: str, grant_order: str, granted_at: str | None = None) -> DataFrame:
    """Elements that the tokens suffice for, in order, with emit_us and tokens_used.

    An element leaves when the tokens granted so far cover the cost of it and all before it. grants has
    the stream's keys, an order, an amount and, if timed, the time of the grant. A negative cost fails.
    """
    cost = F.col(cost) if isinstance(cost, str) else cost
    checked = F.when(cost < 0, F.raise_error(F.lit("a cost must not be negative"))).otherwise(cost.cast("long"))
    by = list(stream.by)
    running = Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = stream.df.withColumn("_v", F.sum(checked).over(stream.running()))
    tau = F.col(granted_at) if granted_at else F.lit(0).cast("long")
    g = grants.select(*by, F.sum(F.col(amount).cast("long")).over(running.orderBy(grant_order)).alias("_v"), F.lit(1).alias("_side"), tau.cast("long").alias("_tau"))
    both = x.withColumn("_side", F.lit(0)).withColumn("_tau", F.lit(None).cast("long")).unionByName(g, allowMissingColumns=True)
    after = Window.partitionBy(*by).orderBy("_v", "_side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = both.withColumn("_ready", F.min("_tau").over(after)).where("_side = 0 and _ready is not null")
    a = F.col(stream.arrival) if stream.arrival else F.lit(0).cast("long")
    return both.withColumn("emit_us", F.greatest(a, F.col("_ready"))).withColumn("tokens_used", F.col("_v")).drop("_v", "_side", "_tau", "_ready")


def valve(stream: Stream, controls: DataFrame, control_at: str, opens: str, initially_open: bool = True) -> DataFrame:
    """A gate: rows that arrive while it is closed leave when it next opens, or never.

    controls has the stream's keys, a time and whether it opens. A control at an element's time
    counts before it. Rows that never leave are absent.
    """
    by = list(stream.by)
    x = stream.df.withColumn("_at", F.col(_arrivals(stream))).withColumn("_side", F.lit(1))
    c = controls.select(*by, F.col(control_at).cast("long").alias("_at"), F.lit(0).alias("_side"), F.col(opens).cast("int").alias("_open"))
    both = x.withColumn("_open", F.lit(None).cast("int")).unionByName(c, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_at", "_side")
    mode = F.coalesce(F.last("_open", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(int(initially_open)))
    later = F.min(F.when(F.col("_open") == 1, F.col("_at"))).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    both = both.withColumn("emit_us", F.when(mode == 1, F.col("_at")).otherwise(later))
    return both.where("_side = 1 and emit_us is not null").drop("_at", "_side", "_open")


def keep_alive(items: list[list[Any]], arrivals: list[int], size: int, interval_us: int, expand: Callable[[Any], list[Any]]) -> list[tuple[int, Any]]:
    """The keep-alive buffer of one stream: (time, element) in the order they leave.

    While the buffer is smaller than ``size`` an arriving element is replaced by its expansion, else it is
    appended whole; one element leaves on arrival and, while the buffer is larger than
    ``size``, more; each tick of the interval lets one go. When the input has ended the next tick
    drains the rest.
    """
    if size < 1:
        raise ValueError("size must be positive")
    buffer: list[Any] = []
    out: list[tuple[int, Any]] = []
    tick = interval_us

    def leave(now: int) -> None:
        if buffer:
            out.append((now, buffer.pop(0)))
        while len(buffer) > size:
            out.append((now, buffer.pop(0)))

    for x, a in zip(items, arrivals, strict=True):
        while tick <= a and buffer:
            leave(tick)
            tick += interval_us
        if tick <= a:
            tick += -(-(a - tick + 1) // interval_us) * interval_us
        buffer.extend(expand(x) if len(buffer) < size else [x])
        leave(a)
    out.extend((tick, b) for b in buffer)
    return out


def keep_alive_concat(stream: Stream, size: int, interval_us: int, element: str, expand: Callable[[Any], list[Any]], element_type: str | None = None) -> DataFrame:
    """by, emit_order, emit_us and the element, for each key's keep-alive buffer."""
    arrival, order, by = _arrivals(stream), stream.order_by, list(stream.by)
    kinds = dict(stream.df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        got = keep_alive(list(rows[element]), [int(a) for a in rows[arrival]], size, interval_us, expand)
        out = pd.DataFrame({"emit_order": range(1, len(got) + 1), "emit_us": [t for t, _ in got], element: [x for _, x in got]})
        for name in by:
            out[name] = rows[name].iloc[0]
        return out[[*by, "emit_order", "emit_us", element]]

    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in by), "emit_order long, emit_us long", f"`{element}` {element_type or kinds[element]}"])
    return stream.df.groupBy(*by).applyInPandas(run, schema)
