"""The named queries over the test tables, and the same in SQL for an independent engine."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import loops, metrics, ordered, routing, timing
from millrace.operators.stream import Stream
from millrace.plans.prefix import global_running
from millrace.sources import archives, files, paged, repeat_eval

HOUR = 3_600_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__.removeprefix("q_")] = f
        if sql:
            SQL[f.__name__.removeprefix("q_")] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *columns: str) -> Stream:
    """events by user, in the order of event_id, with a: microseconds since 2024-01-01."""
    start = "unix_micros(cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp))"
    df = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", *columns, f"unix_micros(cast(ts as timestamp)) - {start} as a")
    return Stream(df, "event_id", ("user_id",), "a")


#: The same base in SQL: columns of events, a, and rn in each user's order.
_B = "b AS (SELECT *, epoch_us(ts) - 1704067200000000 AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)"
_W = "PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING"

# --- ordered ------------------------------------------------------------------------------------


@query(f"SELECT event_id, user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER ({_W}) AS BIGINT) AS acc FROM events")
def q_accumulate(spark, sf_dir):
    return ordered.accumulate(events(spark, sf_dir, "cast(round(value * 100) as bigint) as cents"), "cents", 0).select("event_id", "user_id", "acc")


@query(f"SELECT event_id, user_id, max(value) OVER ({_W}) AS acc FROM events")
def q_accumulate_fold_max(spark, sf_dir):
    return ordered.accumulate(events(spark, sf_dir, "value"), "value", how="max").select("event_id", "user_id", "acc")


@query("SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS acc, row_number() OVER (ORDER BY event_id) AS rn FROM events")
def q_accumulate_global(spark, sf_dir):
    df = events(spark, sf_dir, "cast(round(value * 100) as bigint) as cents").df
    return global_running(df, "event_id", {"acc": "cents"}, "rn").select("event_id", "acc", "rn")


@query(f"SELECT event_id, user_id, CAST(sum(event_id % 7) OVER ({_W}) AS BIGINT) AS acc FROM events")
def q_accumulate_function(spark, sf_dir):
    return ordered.accumulate_with(events(spark, sf_dir), "event_id", 0, lambda acc, x: acc + int(x) % 7, "long").select("event_id", "user_id", "acc")


def _runs_sql(cell: str, chunk: str) -> str:
    return f"""WITH {_B},
x AS (SELECT *, {cell} AS c FROM b),
l AS (SELECT *, CASE WHEN rn = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w OR c <> lag(c) OVER w THEN 1 ELSE 0 END AS chg FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(chg) OVER ({_W}) AS run FROM l),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1 AS pos FROM r)
SELECT user_id, min(event_id) AS first_order, any_value(event_type) AS property, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS elements, count(*) AS n
FROM p GROUP BY user_id, run, {chunk}"""


def _runs(spark, sf_dir, **limits):
    out = ordered.accumulate_while_unchanged(events(spark, sf_dir, "event_type"), "event_type", "event_id", **limits)
    return out.withColumn("elements", F.array_join(F.col("elements").cast("array<string>"), ","))


@query(_runs_sql("0", "pos // 1000000000"))
def q_accumulate_while_unchanged(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(_runs_sql("0", "pos // 2"))
def q_accumulate_while_unchanged_max_elements(spark, sf_dir):
    return _runs(spark, sf_dir, max_elements=2)


@query(_runs_sql(f"a // {12 * HOUR}", "pos // 1000000000"))
def q_accumulate_while_unchanged_max_duration(spark, sf_dir):
    return _runs(spark, sf_dir, max_duration_us=12 * HOUR)


@query(_runs_sql(f"a // {12 * HOUR}", "pos // 2"))
def q_accumulate_while_unchanged_both(spark, sf_dir):
    return _runs(spark, sf_dir, max_elements=2, max_duration_us=12 * HOUR)


@query(f"WITH {_B} SELECT event_id, user_id FROM b WHERE rn % 3 = 0")
def q_sample_nth(spark, sf_dir):
    return ordered.sample_nth(events(spark, sf_dir), 3).select("event_id", "user_id")


@query(f"WITH {_B}, s AS (SELECT CAST(sum(i) OVER (ORDER BY i) AS BIGINT) AS pos FROM range(1, 1001) t(i)) SELECT event_id, user_id FROM b JOIN s ON rn = pos")
def q_sample_steps(spark, sf_dir):
    steps = spark.range(1, 1001).select(F.col("id").alias("step_no"), F.col("id").alias("step"))
    return ordered.sample_steps(events(spark, sf_dir), steps).select("event_id", "user_id")


@query(f"""WITH {_B}, k AS (SELECT unnest(range(1, max(rn) + 1)) AS k FROM b),
s AS (SELECT CAST(sum(CAST('0x' || substr(md5('7:' || k), 1, 15) AS BIGINT) % 10 + 1) OVER (ORDER BY k) AS BIGINT) AS pos FROM k)
SELECT event_id, user_id FROM b JOIN s ON rn = pos""")
def q_sample_random(spark, sf_dir):
    return ordered.sample_random(events(spark, sf_dir), 10, seed=7).select("event_id", "user_id")


_GLOBAL = "b AS (SELECT *, epoch_us(ts) - 1704067200000000 AS a, row_number() OVER (ORDER BY event_id) AS rn FROM events)"


def whole(spark, sf_dir, *columns):
    """events as one sequence."""
    s = events(spark, sf_dir, *columns)
    return Stream(s.df, s.order_by, (), s.arrival)


@query(f"""WITH {_GLOBAL},
l AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS chg FROM b),
r AS (SELECT *, sum(chg) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM l),
p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY event_id) - 1 AS pos FROM r)
SELECT min(event_id) AS first_order, any_value(event_type) AS property, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS elements, count(*) AS n FROM p GROUP BY run, pos // 2""")
def q_accumulate_while_unchanged_global(spark, sf_dir):
    out = ordered.accumulate_while_unchanged(whole(spark, sf_dir, "event_type"), "event_type", "event_id", max_elements=2)
    return out.withColumn("elements", F.array_join(F.col("elements").cast("array<string>"), ","))


@query(f"WITH {_GLOBAL}, c AS (SELECT *, a // {HOUR} AS c FROM b) SELECT event_id, CAST(greatest(a, (rn + greatest(max(c - rn) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0)) * {HOUR}) AS BIGINT) AS emit_us FROM c")
def q_pulse_global(spark, sf_dir):
    return timing.pulse(whole(spark, sf_dir), HOUR).select("event_id", "emit_us")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def q_last_element(spark, sf_dir):
    return ordered.last_element(events(spark, sf_dir, "event_type"), ["event_id", "event_type"])


@query("""WITH f AS (SELECT *, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS bad FROM events)
SELECT user_id, max(event_id) AS event_id FROM f WHERE bad = 0 GROUP BY user_id""")
def q_last_element_before_failure(spark, sf_dir):
    return ordered.last_element(events(spark, sf_dir, "event_type <> 'error' as ok"), ["event_id"], ok="ok")


# --- timing -------------------------------------------------------------------------------------


def _delay_sql(d: str, before: str = "") -> str:
    return f"""WITH {_B}{before}, d AS (SELECT *, {d} AS d FROM {'g' if before else 'b'}), s AS (SELECT *, CAST(sum(d) OVER ({_W}) AS BIGINT) AS cd FROM d)
SELECT event_id, user_id, CAST(cd + max(a - (cd - d)) OVER ({_W}) AS BIGINT) AS emit_us FROM s"""


@query(_delay_sql(str(HOUR)))
def q_delay_fixed(spark, sf_dir):
    return timing.delay_fixed(events(spark, sf_dir), HOUR).select("event_id", "user_id", "emit_us")


@query(_delay_sql(f"(1 + event_id % 7) * {HOUR}"))
def q_delay_column(spark, sf_dir):
    return timing.delay_by(events(spark, sf_dir), (1 + F.col("event_id") % 7) * HOUR).select("event_id", "user_id", "emit_us")


_ISLANDS = f", f AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flag FROM b), i AS (SELECT *, sum(1 - flag) OVER ({_W}) AS isl FROM f), g AS (SELECT *, CAST(sum(flag) OVER (PARTITION BY user_id, isl ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS k FROM i)"


@query(_delay_sql(f"CASE WHEN flag = 1 THEN least({HOUR} + k * {2 * HOUR}, {6 * HOUR}) ELSE {HOUR} END", _ISLANDS))
def q_delay_linear(spark, sf_dir):
    return timing.delay_linear(events(spark, sf_dir, "event_type"), 2 * HOUR, F.col("event_type") == "error", HOUR, 6 * HOUR).select("event_id", "user_id", "emit_us")


class _Linear:
    """Grows with each error, falls back otherwise; one object for each key."""

    def __init__(self) -> None:
        self.k = 0

    def __call__(self, row: dict) -> int:
        self.k = self.k + 1 if row["event_type"] == "error" else 0
        return min(HOUR + self.k * 2 * HOUR, 6 * HOUR)


@query(_delay_sql(f"CASE WHEN flag = 1 THEN least({HOUR} + k * {2 * HOUR}, {6 * HOUR}) ELSE {HOUR} END", _ISLANDS))
def q_delay_strategy(spark, sf_dir):
    return timing.delay_strategy(events(spark, sf_dir, "event_type"), _Linear).select("event_id", "user_id", "emit_us")


def _pulse_sql(g0: int) -> str:
    i = 10 * HOUR
    return f"WITH {_B}, c AS (SELECT *, a // {i} AS c FROM b) SELECT event_id, user_id, CAST(greatest(a, (rn + greatest(max(c - rn) OVER ({_W}), {g0})) * {i}) AS BIGINT) AS emit_us FROM c"


@query(_pulse_sql(0))
def q_pulse_closed(spark, sf_dir):
    return timing.pulse(events(spark, sf_dir), 10 * HOUR).select("event_id", "user_id", "emit_us")


@query(_pulse_sql(-1))
def q_pulse_open(spark, sf_dir):
    return timing.pulse(events(spark, sf_dir), 10 * HOUR, True).select("event_id", "user_id", "emit_us")


@query("SELECT user_id, epoch_us(time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01')) AS window_start_us, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2")
def q_time_window_tumbling(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", "value", "ts")
    out = timing.time_window_tumbling(df, "ts", ["user_id"], "12 hours", n=F.count(F.lit(1)), top=F.max("value"))
    start = "unix_micros(cast(window_start as timestamp)) - unix_micros(cast(timestamp_ntz'1970-01-01 00:00:00' as timestamp))"
    return out.selectExpr("user_id", f"{start} as window_start_us", "n", "top")


def _window_sql(eager: int) -> str:
    i = 12 * HOUR
    return f"""WITH {_B},
x AS (SELECT *, a // {i} AS c FROM b),
k AS (SELECT user_id, c, count(*) AS n FROM x GROUP BY user_id, c),
l AS (SELECT *, lag(c) OVER w AS pc, lag(n) OVER w AS pn FROM k WINDOW w AS (PARTITION BY user_id ORDER BY c)),
v AS (SELECT *, CASE WHEN pc IS NULL THEN CASE WHEN c = 0 THEN {eager} ELSE 1 END WHEN c > pc + 1 THEN 1 WHEN pn >= 2 THEN 0 END AS dec FROM l),
gid AS (SELECT *, count(dec) OVER (PARTITION BY user_id ORDER BY c ROWS UNBOUNDED PRECEDING) AS gr FROM v),
ar AS (SELECT user_id, c, max(dec) OVER (PARTITION BY user_id, gr) AS armed FROM gid),
y AS (SELECT x.*, armed, row_number() OVER (PARTITION BY x.user_id, x.c ORDER BY event_id) AS p FROM x JOIN ar ON x.user_id = ar.user_id AND x.c = ar.c),
z AS (SELECT user_id, event_id, c, CASE WHEN armed = 1 AND p = 1 THEN 1 ELSE 0 END AS alone, CASE WHEN armed = 1 AND p = 1 THEN a ELSE (c + 1) * {i} END AS emit_us FROM y)
SELECT user_id, emit_us, min(event_id) AS first_order, count(*) AS n FROM z GROUP BY user_id, c, alone, emit_us"""


def _time_window(spark, sf_dir, eager):
    out = timing.time_window(events(spark, sf_dir), 12 * HOUR, eager)
    return out.groupBy("user_id", "_cell", "alone", "emit_us").agg(F.min("event_id").alias("first_order"), F.count(F.lit(1)).alias("n")).drop("_cell", "alone")


@query(_window_sql(1))
def q_time_window_faithful(spark, sf_dir):
    return _time_window(spark, sf_dir, True)


@query(_window_sql(0))
def q_time_window_faithful_lazy(spark, sf_dir):
    return _time_window(spark, sf_dir, False)


_GROUPED = f"""WITH {_B}, x AS (SELECT *, a // {12 * HOUR} AS c FROM b),
p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, c ORDER BY event_id) - 1) // 2 AS ch FROM x),
g AS (SELECT user_id, c, ch, min(event_id) AS first_order, count(*) AS n, CASE WHEN count(*) = 2 THEN max(a) ELSE (c + 1) * {12 * HOUR} END AS ready_us FROM p GROUP BY user_id, c, ch)"""


@query(_GROUPED + " SELECT user_id, first_order, n, ready_us FROM g")
def q_grouped_within(spark, sf_dir):
    return timing.grouped_within(events(spark, sf_dir), 2, 12 * HOUR, "event_id").select("user_id", "first_order", "n", "ready_us")


@query(_GROUPED + f""", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_order) AS i FROM g)
SELECT user_id, first_order, n, CAST(i * {12 * HOUR} + max(ready_us - (i - 1) * {12 * HOUR}) OVER (PARTITION BY user_id ORDER BY first_order ROWS UNBOUNDED PRECEDING) AS BIGINT) AS emit_us FROM r""")
def q_interval_rate_limiter(spark, sf_dir):
    return timing.interval_rate_limiter(events(spark, sf_dir), 12 * HOUR, 2, "event_id").select("user_id", "first_order", "n", "emit_us")


@query(f"""WITH x AS (SELECT event_id, user_id, CAST(sum(1 + event_id % 5) OVER ({_W}) AS BIGINT) AS cc FROM events),
t AS (SELECT user_id, 8 * count(*) AS total FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT event_id, x.user_id, cc AS tokens_used FROM x JOIN t ON x.user_id = t.user_id WHERE cc <= total""")
def q_token_throttle(spark, sf_dir):
    s = events(spark, sf_dir, "event_type")
    grants = s.df.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("g"), F.lit(8).alias("amount"))
    return timing.token_throttle(s, 1 + F.col("event_id") % 5, grants, "amount", "g").select("event_id", "user_id", "tokens_used")


@query(f"""WITH {_B}, x AS (SELECT *, CAST(sum(1 + event_id % 5) OVER ({_W}) AS BIGINT) AS cc FROM b),
t AS (SELECT user_id, a AS tau, CAST(8 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS kk FROM b WHERE event_type = 'purchase'),
u AS (SELECT user_id, event_id, a, cc AS v, 0 AS side, NULL AS tau FROM x UNION ALL SELECT user_id, NULL, NULL, kk, 1, tau FROM t),
r AS (SELECT *, min(tau) OVER (PARTITION BY user_id ORDER BY v, side ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ready FROM u)
SELECT event_id, user_id, greatest(a, ready) AS emit_us FROM r WHERE side = 0 AND ready IS NOT NULL""")
def q_token_throttle_timed(spark, sf_dir):
    s = events(spark, sf_dir, "event_type")
    grants = s.df.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("g"), F.lit(8).alias("amount"), F.col("a").alias("at"))
    return timing.token_throttle(s, 1 + F.col("event_id") % 5, grants, "amount", "g", "at").select("event_id", "user_id", "emit_us")


@query(f"""WITH {_B}, c AS (SELECT user_id, a AS ca, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS op FROM b WHERE event_type IN ('signup', 'error')),
x AS (SELECT * FROM b WHERE event_type NOT IN ('signup', 'error')),
m AS (SELECT x.event_id, x.user_id, x.a, coalesce((SELECT arg_max(op, ca) FROM c WHERE c.user_id = x.user_id AND c.ca <= x.a), 1) AS mode, (SELECT min(ca) FROM c WHERE c.user_id = x.user_id AND c.op = 1 AND c.ca > x.a) AS nxt FROM x)
SELECT event_id, user_id, CASE WHEN mode = 1 THEN a ELSE nxt END AS emit_us FROM m WHERE mode = 1 OR nxt IS NOT NULL""")
def q_valve(spark, sf_dir):
    s = events(spark, sf_dir, "event_type")
    controls = s.df.where("event_type in ('signup', 'error')").select("user_id", F.col("a").alias("at"), (F.col("event_type") == "error").alias("opens"))
    rows = s.having(s.df.where("event_type not in ('signup', 'error')"))
    return timing.valve(rows, controls, "at", "opens").select("event_id", "user_id", "emit_us")


#: The buffer's size after each arrival follows from the size before: ticks in between let one element go each, the
#: arrival adds three or one, and one element leaves, more if the buffer is larger than 4.
_KEEP_ALIVE = f"""WITH RECURSIVE {_B},
r AS (SELECT user_id, rn, event_id, a, a AS before, CAST(0 AS BIGINT) AS ticks, CAST(3 AS BIGINT) AS added, CAST(1 AS BIGINT) AS leave, CAST(2 AS BIGINT) AS held FROM b WHERE rn = 1
 UNION ALL SELECT user_id, rn, event_id, a, before, ticks, added, 1 + greatest(0, l + added - 5), l + added - 1 - greatest(0, l + added - 5)
 FROM (SELECT *, CASE WHEN l < 4 THEN 3 ELSE 1 END AS added FROM (SELECT b.user_id, b.rn, b.event_id, b.a, r.a AS before, least(b.a // {HOUR} - r.a // {HOUR}, r.held) AS ticks, r.held - least(b.a // {HOUR} - r.a // {HOUR}, r.held) AS l
  FROM r JOIN b ON b.user_id = r.user_id AND b.rn = r.rn + 1))),
times AS (SELECT user_id, rn, 0 AS part, k, (before // {HOUR} + 1 + k) * {HOUR} AS t FROM r, LATERAL (SELECT unnest(range(ticks)) AS k)
 UNION ALL SELECT user_id, rn, 1, k, a FROM r, LATERAL (SELECT unnest(range(leave)) AS k)
 UNION ALL SELECT user_id, rn, 2, k, (a // {HOUR} + 1) * {HOUR} FROM (SELECT *, max(rn) OVER (PARTITION BY user_id) AS top FROM r) x, LATERAL (SELECT unnest(range(held)) AS k) WHERE rn = top),
items AS (SELECT user_id, rn, k, CASE WHEN added = 3 THEN CAST(event_id * 3 + k AS VARCHAR) ELSE concat_ws(',', event_id * 3, event_id * 3 + 1, event_id * 3 + 2) END AS item FROM r, LATERAL (SELECT unnest(range(added)) AS k)),
left_at AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY rn, part, k) AS p FROM times),
queued AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY rn, k) AS p FROM items)
SELECT user_id, p AS emit_order, CAST(t AS BIGINT) AS emit_us, item FROM queued JOIN left_at USING (user_id, p)"""


@query(_KEEP_ALIVE)
def q_keep_alive_concat(spark, sf_dir):
    s = events(spark, sf_dir)
    s = s.having(s.df.select("event_id", "user_id", "a", F.array(*[F.col("event_id") * 3 + i for i in range(3)]).alias("items")))
    out = timing.keep_alive_concat(s, 4, HOUR, "items", lambda x: [[i] for i in x])
    return out.select("user_id", "emit_order", "emit_us", F.array_join(F.col("items").cast("array<string>"), ",").alias("item"))


# --- routing ------------------------------------------------------------------------------------


def _parted(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    keys = ["l_orderkey", "l_linenumber"]
    return routing.partition_with(df, F.col("l_partkey") % 2 == 0, [*keys, F.expr("l_partkey div 2").alias("value")], [*keys, (F.col("l_partkey") * 3 - 1).alias("value")])


@query("SELECT l_orderkey, l_linenumber, l_partkey // 2 AS value FROM lineitem WHERE l_partkey % 2 = 0")
def q_partition_with_left(spark, sf_dir):
    return _parted(spark, sf_dir)[0]


@query("SELECT l_orderkey, l_linenumber, l_partkey * 3 - 1 AS value FROM lineitem WHERE l_partkey % 2 <> 0")
def q_partition_with_right(spark, sf_dir):
    return _parted(spark, sf_dir)[1]


@query("SELECT o_orderkey, o_custkey, o_custkey * o_custkey AS squared FROM orders")
def q_pass_through(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return routing.pass_through(df, lambda x: x.withColumn("sq", F.col("o_custkey") * F.col("o_custkey")), "o_orderkey", "sq", "squared")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS emit_position FROM events")
def q_merge_by_index(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id")
    return routing.merge_by_index([df.where(F.col("event_id") % 5 == i) for i in range(5)], "event_id", "event_id")


@query("""WITH x AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS p FROM events WHERE event_type = 'purchase'),
y AS (SELECT event_id AS other_id, row_number() OVER (ORDER BY event_id) AS p FROM events WHERE event_type = 'error')
SELECT event_id, other_id FROM x JOIN y USING (p)""")
def q_zip_by_position(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    other = df.where("event_type = 'error'").select(F.col("event_id").alias("other_id"))
    return routing.zip_by_position(df.where("event_type = 'purchase'").select("event_id"), other, "event_id", "other_id")


# --- loops --------------------------------------------------------------------------------------


def _collatz(n: int) -> tuple[int, int] | None:
    return None if n == 1 else (n // 2 if n % 2 == 0 else 3 * n + 1, n)


_COLLATZ = """WITH RECURSIVE t(seed, step, n) AS (SELECT p_partkey, CAST(1 AS BIGINT), p_partkey FROM part WHERE p_partkey > 0
UNION ALL SELECT seed, step + 1, CASE WHEN n % 2 = 0 THEN n // 2 ELSE 3 * n + 1 END FROM t WHERE n <> 1)
SELECT seed, step, n AS element FROM t"""


@query(_COLLATZ + " WHERE n <> 1")
def q_unfold_flow_with(spark, sf_dir):
    return loops.unfold_flow_with(table(spark, sf_dir, "part").where("p_partkey > 0"), "p_partkey", _collatz, "long")


@query(_COLLATZ)
def q_unfold_flow(spark, sf_dir):
    def flow(n):
        if n == 1:
            raise StopIteration(1)
        return _collatz(n)

    return loops.unfold_flow(table(spark, sf_dir, "part").where("p_partkey > 0"), "p_partkey", flow, "long")


@query("""WITH RECURSIVE t(seed, step, n) AS (SELECT s_suppkey, CAST(1 AS BIGINT), s_suppkey FROM supplier WHERE s_suppkey > 0
UNION ALL SELECT seed, step + 1, CASE WHEN n % 2 = 0 THEN n // 2 ELSE 3 * n + 1 END FROM t WHERE n <> 1) SELECT seed, step, n AS element FROM t WHERE n <> 1""")
def q_unfold_sql(spark, sf_dir):
    seeds = table(spark, sf_dir, "supplier").where("s_suppkey > 0").select("s_suppkey")
    return loops.unfold_sql(seeds, "s_suppkey", "CASE WHEN state % 2 = 0 THEN state div 2L ELSE 3L * state + 1L END", "state <> 1", 500)


_HALVES = "WITH RECURSIVE t(src, i, depth) AS (SELECT event_id, event_id, CAST(0 AS BIGINT) FROM events UNION ALL SELECT src, i // 2, depth + 1 FROM t WHERE i % 2 = 1) SELECT src, i, depth AS iteration FROM t WHERE i % 2 = 0"


@query(_HALVES)
def q_feedback_loop(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("src"), F.col("event_id").alias("i"))
    return loops.feedback_loop(df, lambda x: (x.where("i % 2 = 0"), x.where("i % 2 = 1").withColumn("i", F.expr("i div 2"))))


@query("WITH RECURSIVE t(src, i) AS (SELECT n_nationkey, n_nationkey FROM nation UNION ALL SELECT src, i - 1 FROM t WHERE i > 0) SELECT src AS source, CAST(row_number() OVER (PARTITION BY src ORDER BY i DESC) AS BIGINT) AS emit_order, i AS element FROM t")
def q_feedback_countdown(spark, sf_dir):
    return loops.feedback_each(table(spark, sf_dir, "nation"), "n_nationkey", lambda i: ([i], [i - 1] if i > 0 else []), "int")


@query("WITH RECURSIVE f(k, a, b) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT k + 1, b, a + b FROM f WHERE k < 20) SELECT k AS emit_order, a AS element FROM f")
def q_feedback_fibonacci(spark, sf_dir):
    seeds = spark.sql("SELECT struct(0L AS n, 1L AS n1, 1L AS k) AS state")
    out = loops.feedback_each(
        seeds.select(F.to_json("state").alias("state")), "state",
        lambda s: (lambda d: ([d["n"]], [f'{{"n":{d["n1"]},"n1":{d["n"] + d["n1"]},"k":{d["k"] + 1}}}'] if d["k"] < 20 else []))(__import__("json").loads(s)), "long",
    )
    return out.select("emit_order", "element")


def _parity(i: int) -> int:
    if i % 2 == 0:
        raise ValueError("even")
    return i + 1


@query("""WITH RECURSIVE t(src, i, s, att) AS (SELECT event_id, event_id % 100, event_id % 50, CAST(1 AS BIGINT) FROM events
UNION ALL SELECT src, s + 1, s + 1, att + 1 FROM t WHERE i % 2 = 0 AND s < 42)
SELECT src AS key, i % 2 = 1 AS ok, CASE WHEN i % 2 = 1 THEN i + 1 ELSE -1 END AS result, s AS state, att AS attempts FROM t WHERE i % 2 = 1 OR s >= 42""")
def q_retry(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 100 as i", "event_id % 50 as s")
    out = loops.retry(df, "event_id", "i", "s", _parity, lambda s: (s + 1, s + 1) if s < 42 else None, "long")
    return out.select("key", "ok", F.coalesce("result", F.lit(-1)).alias("result"), "state", "attempts")


@query("""WITH e AS (SELECT event_id, event_id % 4 AS i FROM events)
SELECT event_id AS key, CAST(1 AS BIGINT) AS emit_order, i + 1 AS result FROM e WHERE i % 2 = 1
UNION ALL SELECT event_id, CAST(k AS BIGINT), CAST(2 AS BIGINT) FROM e, range(1, 17) r(k) WHERE i % 2 = 0 AND k <= i * i""")
def q_retry_concat(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 4 as i", "(event_id % 4) * (event_id % 4) as s")
    return loops.retry_concat(df, "event_id", "i", "s", _parity, lambda s: [(1, s)] * s, "long", 100).select("key", "emit_order", "result")


# --- metrics ------------------------------------------------------------------------------------


@query("SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us, count(*) AS n FROM events GROUP BY user_id")
def q_timed(spark, sf_dir):
    return metrics.timed(events(spark, sf_dir))


@query(f"WITH {_B}, l AS (SELECT event_id, user_id, a - lag(a) OVER (PARTITION BY user_id ORDER BY event_id) AS interval_us FROM b WHERE event_type = 'purchase') SELECT * FROM l WHERE interval_us IS NOT NULL")
def q_timed_interval_between(spark, sf_dir):
    return metrics.timed_interval_between(events(spark, sf_dir, "event_type"), F.col("event_type") == "purchase").select("event_id", "user_id", "interval_us")


@query(f"""WITH {_B}, l AS (SELECT e.event_id, e.user_id, e.a, (SELECT max(s.a) FROM b s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.a <= e.a) AS started_us FROM b e WHERE e.event_type = 'purchase')
SELECT event_id, user_id, started_us, a - started_us AS latency_us FROM l WHERE started_us IS NOT NULL""")
def q_latency_timer(spark, sf_dir):
    df = events(spark, sf_dir, "event_type").df
    out = metrics.latency_timer(df.where("event_type = 'signup'"), df.where("event_type = 'purchase'"), ["user_id"], "a", "a")
    return out.select("event_id", "user_id", "started_us", "latency_us")


@query(_delay_sql(str(HOUR)).replace("SELECT event_id, user_id, CAST(", "SELECT event_id, CAST(").replace("AS emit_us", "- a AS latency_us"))
def q_measure_latency(spark, sf_dir):
    """Time from arrival until an element leaves a delay."""
    return metrics.measure_latency(events(spark, sf_dir), lambda s: timing.delay_fixed(s, HOUR).drop("a"), "event_id").select("event_id", "latency_us")


# --- sources ------------------------------------------------------------------------------------


@query("SELECT c_custkey AS item, (c_custkey // 100) - (SELECT min(c_custkey) // 100 FROM customer) + 1 AS page_no FROM customer")
def q_paged_source(spark, sf_dir):
    page = F.expr("c_custkey div 100")
    pages = table(spark, sf_dir, "customer").groupBy(page.alias("page_key")).agg(F.array_sort(F.collect_list("c_custkey")).alias("items"))
    pages = pages.withColumn("next_key", F.col("page_key") + 1)
    first = pages.agg(F.min("page_key")).first()[0]
    return paged.paged_table(pages, first, 100_000).select("item", "page_no")


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            inner, outer = io.BytesIO(), io.BytesIO()
            with zipfile.ZipFile(inner, "w") as z:
                z.writestr(f"{i}.txt", text or "")
            with zipfile.ZipFile(outer, "w") as z:
                z.writestr("nested.zip", inner.getvalue())
            out.append((str(i), outer.getvalue()))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], names=["path", "content"])


@query("""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)
SELECT CAST(doc_id AS VARCHAR) || '.txt' AS name, CAST(k AS BIGINT) AS chunk_no, CAST(length(c) // 2 AS BIGINT) AS size, md5(unhex(c)) AS digest
FROM (SELECT doc_id, k, substr(h, CAST(k * 2000 + 1 AS BIGINT), 2000) AS c FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 + 999) // 1000)) AS k FROM d))""")
def q_zip_entries(spark, sf_dir):
    zips = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_zipped, "path string, content binary")
    return archives.zip_entries(zips, 1000).select("name", "chunk_no", F.octet_length("chunk").cast("long").alias("size"), F.md5("chunk").alias("digest"))


@query("SELECT CAST(doc_id AS VARCHAR) AS archive, CAST(octet_length(encode(text)) AS BIGINT) AS total_bytes FROM documents WHERE text <> ''")
def q_zip_total_bytes(spark, sf_dir):
    zips = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_zipped, "path string, content binary")
    return archives.total_bytes(archives.zip_entries(zips))


@query("""WITH a AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n_chars FROM documents WHERE doc_id % 5 <> 0)
SELECT CAST(coalesce(a.doc_id, b.doc_id) AS VARCHAR) AS path, CASE WHEN a.doc_id IS NULL THEN 'Creation' WHEN b.doc_id IS NULL THEN 'Deletion' ELSE 'Modification' END AS change
FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.n_chars IS DISTINCT FROM b.n_chars""")
def q_directory_changes(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    listing = lambda where, size: df.where(where).select(F.col("doc_id").cast("string").alias("path"), F.lit(0).cast("long").alias("mtime_us"), F.expr(size).alias("size"))
    return files.directory_changes(listing("doc_id % 7 <> 0", "n_chars"), listing("doc_id % 5 <> 0", "n_chars + if(doc_id % 3 = 0, 1, 0)"))


@query("""WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents)
SELECT doc_id, CAST(p AS BIGINT) AS position, CAST(length(c) // 2 AS BIGINT) AS size, md5(unhex(c)) AS digest
FROM (SELECT doc_id, p, substr(h, CAST(p * 2 + 1 AS BIGINT), 1024) AS c FROM (SELECT doc_id, h, unnest(range(100, length(h) // 2, 512)) AS p FROM d))""")
def q_file_tail(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return files.byte_chunks(df, "doc_id", "content", 100, 512).select("doc_id", "position", F.octet_length("chunk").cast("long").alias("size"), F.md5("chunk").alias("digest"))


@query()
def q_source_repeat_eval(spark, sf_dir):
    return repeat_eval.repeat_eval(spark, 1000, F.rand(3))
