"""Fixed small cases of every stream operator."""

import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.operators import loops, metrics, ordered, routing, timing
from millrace.operators.stream import Stream
from millrace.sources import archives, files, paged, repeat_eval

S = 1_000_000


def seq(spark, values, names="seq long, x long"):
    return spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], names)


def col(df, name, order="seq"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_accumulate(spark):
    s = Stream(seq(spark, [1, 2, 3]), "seq")
    assert col(ordered.accumulate(s, "x", 0), "acc") == [1, 3, 6]
    assert col(ordered.accumulate_with(s, "x", "", lambda a, x: a + str(x), "string"), "acc") == ["1", "12", "123"]
    assert ordered.accumulate(s.having(s.df.where("false")), "x", 0).count() == 0


@pytest.mark.parametrize("limits,expected", [({}, [[1, 2, 3], [4, 5], [6]]), ({"max_elements": 2}, [[1, 2], [3], [4, 5], [6]])])
def test_runs(spark, limits, expected):
    df = seq(spark, [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3)], "seq long, id int, value int")
    out = ordered.accumulate_while_unchanged(Stream(df, "seq"), "value", "id", **limits)
    assert col(out, "elements", "first_order") == expected


def test_runs_of_nulls_and_ticks(spark):
    df = spark.createDataFrame([(0, None, 0), (1, None, 5), (2, 7, 12)], "seq long, p int, a long")
    assert col(ordered.accumulate_while_unchanged(Stream(df, "seq", (), "a"), "p", "seq"), "n", "first_order") == [2, 1]
    assert col(ordered.accumulate_while_unchanged(Stream(df, "seq", (), "a"), "p", "seq", max_duration_us=5), "n", "first_order") == [1, 1, 1]
    with pytest.raises(ValueError):
        ordered.accumulate_while_unchanged(Stream(df, "seq"), "p", "seq", max_elements=0)


def test_samples(spark):
    s = Stream(spark.range(1, 101).withColumnRenamed("id", "x"), "x")
    for n in (1, 3, 100):
        assert col(ordered.sample_nth(s, n), "x", "x") == [x for x in range(1, 101) if x % n == 0]
    steps = spark.createDataFrame([(i, i) for i in range(1, 20)], "step_no long, step long")
    ten = Stream(spark.range(1, 11).withColumnRenamed("id", "x"), "x")
    assert col(ordered.sample_steps(ten, steps), "x", "x") == [1, 3, 6, 10]
    with pytest.raises(Exception, match="positive"):
        ordered.sample_steps(ten, spark.createDataFrame([(1, 0)], "step_no long, step long")).collect()
    for bad in (ordered.sample_nth, ordered.sample_random):
        with pytest.raises(ValueError):
            bad(s, 0)
    got = col(ordered.sample_random(s, 5, seed=1), "x", "x")
    assert got and all(1 <= b - a <= 5 for a, b in zip([0, *got], got))


def test_last_element(spark):
    df = spark.createDataFrame([(0, 1, True), (1, 2, True), (2, 3, True), (3, 4, False), (4, 5, True)], "seq long, x int, ok boolean")
    assert ordered.last_element(Stream(df.where("seq < 3"), "seq"), ["x"]).first().x == 3
    assert ordered.last_element(Stream(df, "seq"), ["x"], "ok").first().x == 3
    assert ordered.last_element(Stream(df.where("false"), "seq"), ["x"]).first().x is None


def test_delays(spark):
    df = spark.createDataFrame([(i, i, 0) for i in range(1, 11)], "seq long, x int, a long")
    s = Stream(df, "seq", (), "a")
    assert col(timing.delay_fixed(s, S), "emit_us") == [i * S for i in range(1, 11)]
    assert col(timing.delay_fixed(s, 0), "emit_us") == [0] * 10
    out = timing.delay_linear(s, S, F.col("x") < 7, S, 5 * S)
    assert col(out, "delay_us") == [d * S for d in (2, 3, 4, 5, 5, 5, 1, 1, 1, 1)]
    with pytest.raises(ValueError):
        timing.delay_linear(s, 0, F.lit(True))


def test_closed_forms_against_event_by_event(spark):
    r = random.Random(4)
    rows, want = [], {}
    for key in range(40):
        a, left, pulses = 0, None, {True: -1, False: 0}
        for i in range(30):
            a += r.choice([0, 1, 3, 20])
            d = r.choice([0, 2, 9])
            left = max(a, left if left is not None else a) + d
            ticks = {}
            for opened in pulses:
                pulses[opened] = max(pulses[opened] + 1, a // 10)
                ticks[opened] = max(a, pulses[opened] * 10)
            rows.append((key, i, a, d))
            want[key, i] = (left, ticks[False], ticks[True])
    s = Stream(spark.createDataFrame(rows, "k long, seq long, a long, d long"), "seq", ("k",), "a")
    df = timing.delay_by(s, "d", "e1")
    df = timing.pulse(s.having(df), 10, False, "e2")
    df = timing.pulse(s.having(df), 10, True, "e3")
    assert {(x.k, x.seq): (x.e1, x.e2, x.e3) for x in df.collect()} == want


def conflated(arrivals, interval, eager):
    """Event by event: (emit, members) of a pulsed conflating buffer."""
    out, waiting, armed, tick = [], [], eager, interval
    for i, a in enumerate(arrivals):
        while tick <= a:
            if waiting:
                out.append((tick, waiting))
                waiting = []
            else:
                armed = True
            tick += interval
        if armed:
            out.append((a, [i]))
            armed = False
        else:
            waiting = [*waiting, i]
    if waiting:
        out.append((tick, waiting))
    return out


@pytest.mark.parametrize("eager", [True, False])
def test_time_window_against_event_by_event(spark, eager):
    r, rows, want = random.Random(9), [], set()
    for key in range(60):
        a, arrivals = 0, []
        for _ in range(r.randint(1, 25)):
            a += r.choice([0, 1, 4, 13, 40])
            arrivals.append(a)
        rows += [(key, i, a) for i, a in enumerate(arrivals)]
        want |= {(key, t, tuple(m)) for t, m in conflated(arrivals, 10, eager)}
    s = Stream(spark.createDataFrame(rows, "k long, seq long, a long"), "seq", ("k",), "a")
    out = timing.time_window(s, 10, eager).groupBy("k", "_cell", "alone", "emit_us").agg(F.sort_array(F.collect_list("seq")).alias("m"))
    assert {(x.k, x.emit_us, tuple(x.m)) for x in out.collect()} == want


@pytest.mark.parametrize("n,size", [(6, 1), (300, 10), (600, 200), (6000, 2000)])
def test_rate_limiter(spark, n, size):
    df = spark.range(n).select(F.col("id").alias("seq"), F.lit(0).cast("long").alias("a"))
    rows = timing.interval_rate_limiter(Stream(df, "seq", (), "a"), 100, size, "seq").orderBy("first_order").collect()
    assert [x for r in rows for x in r.elements] == list(range(n))
    assert len(rows) in (n // size, n // size + 1)
    assert all(b.emit_us - a.emit_us >= 100 for a, b in zip(rows, rows[1:]))


def test_keep_alive(spark):
    items = [[1, 2, 3], [4, 5, 6], [7, 8, 9], [10]]
    got = timing.keep_alive(items, [0, 0, 0, 0], 2, S, lambda x: [[i] for i in x])
    assert [x for _, x in got] == [[1], [2], [3], [4, 5, 6], [7, 8, 9], [10]]
    gap = timing.keep_alive([[1, 2, 3], [4, 5], [6, 7, 8], [9, 10]], [0, 0, 2 * S, 2 * S], 5, 600_000, lambda x: [[i] for i in x])
    assert [i for _, x in gap for i in x] == list(range(1, 11))
    df = spark.createDataFrame([(1, i, 0, x) for i, x in enumerate(items)], "k int, seq long, a long, items array<int>")
    out = timing.keep_alive_concat(Stream(df, "seq", ("k",), "a"), 2, S, "items", lambda x: [[i] for i in x])
    assert col(out, "items", "emit_order") == [[1], [2], [3], [4, 5, 6], [7, 8, 9], [10]]


def test_tokens(spark):
    s = Stream(spark.range(25).withColumnRenamed("id", "seq"), "seq")
    grants = spark.range(10).select(F.col("id").alias("g"), F.lit(10).alias("amount"))
    out = timing.token_throttle(s, F.lit(1), grants, "amount", "g")
    assert out.count() == 25 and out.agg(F.max("tokens_used")).first()[0] == 25
    forty = Stream(spark.range(1, 41).withColumnRenamed("id", "seq"), "seq")
    ones = spark.range(1000).select(F.col("id").alias("g"), F.lit(1).alias("amount"))
    assert timing.token_throttle(forty, "seq", ones, "amount", "g").agg(F.max("tokens_used")).first()[0] == 820
    short = timing.token_throttle(s, F.lit(5), grants.limit(1).withColumn("amount", F.lit(8)), "amount", "g")
    assert short.count() == 1
    with pytest.raises(Exception, match="negative"):
        timing.token_throttle(s, F.lit(-1), grants, "amount", "g").collect()


def test_valve(spark):
    rows = Stream(spark.range(1, 6).select(F.col("id").alias("seq"), F.col("id").alias("a")), "seq", (), "a")
    opened = spark.createDataFrame([(100, True)], "at long, o boolean")
    assert col(timing.valve(rows, opened, "at", "o", initially_open=False), "emit_us") == [100] * 5
    closed = spark.createDataFrame([(3, False)], "at long, o boolean")
    assert col(timing.valve(rows, closed, "at", "o"), "seq") == [1, 2]


def test_routing(spark):
    df = seq(spark, [1, 2, 3])
    left, right = routing.partition_with(df, F.col("x") % 2 == 0, [F.expr("x div 2").alias("v")], [(F.col("x") * 3 - 1).alias("v")])
    assert [r.v for r in left.collect()] == [1] and sorted(r.v for r in right.collect()) == [2, 8]
    assert [r.either.side for r in routing.either(df, F.col("x") == 2, F.lit("l"), F.lit("r")).orderBy("seq").collect()] == ["right", "left", "right"]
    out = routing.pass_through(df, lambda d: d.withColumn("s", F.col("x").cast("string")), "seq", "s")
    assert col(out, "result") == ["1", "2", "3"]
    with pytest.raises(Exception, match="one row for each"):
        routing.pass_through(df, lambda d: d.where("x > 1").withColumn("s", F.lit(1)), "seq", "s").collect()
    assert [r.item for r in routing.flattened(df.select("seq", F.array("x", "x").alias("xs")), "xs").collect()] == [1, 1, 2, 2, 3, 3]


def merge(spark, *inputs):
    parts = [spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "o long, idx long") for xs in inputs]
    return [r.idx for r in routing.merge_by_index(parts, "idx", "o").orderBy("emit_position").collect()]


def test_merge_by_index(spark):
    assert merge(spark, [1], [0]) == [0, 1]
    assert merge(spark, [1], [2], [3]) == [1, 2, 3]
    r = random.Random(2)
    kept = [x for x in range(1000) if r.random() < 0.8]
    dealt = [[] for _ in range(20)]
    for x in kept:
        r.choice(dealt).append(x)
    assert merge(spark, *dealt) == kept
    for bad in ([[1], [0], [1]], [[2, 1]], [[-1]]):
        with pytest.raises(Exception, match="index"):
            merge(spark, *bad)


def test_loops(spark):
    def half(x):
        return x.where("i % 2 = 0"), x.where("i % 2 = 1").withColumn("i", F.expr("i div 2"))

    df = spark.range(1, 1001).withColumnRenamed("id", "i")
    out = loops.feedback_loop(df, half)
    assert out.count() == 1000 and out.where("i % 2 <> 0").count() == 0
    with pytest.raises(OverflowError):
        loops.feedback_loop(df, half, feedback_buffer_size=10)
    five = spark.createDataFrame([(5,)], "i int")
    down = loops.feedback_each(five, "i", lambda i: ([i], [i - 1] if i else []), "int")
    assert col(down, "element", "emit_order") == [5, 4, 3, 2, 1, 0]


def test_retries(spark):
    def parity(i):  # here, so that it is sent to the workers by value
        if i % 2 == 0:
            raise ValueError("even")
        return i + 1

    df = spark.createDataFrame([(0, 1, 0), (1, 2, 2), (2, 42, 42)], "k int, i int, s int")
    got = loops.retry(df, "k", "i", "s", parity, lambda s: (s + 1, s + 1) if s < 42 else None, "int").orderBy("key").collect()
    assert [(r.ok, r.result) for r in got] == [(True, 2), (True, 4), (False, None)]
    filled = spark.createDataFrame([(0, 1, 1), (1, 3, 9), (2, 2, 4)], "k int, i int, s int")
    got = loops.retry_concat(filled, "k", "i", "s", parity, lambda s: [(1, 1)] * s, "int", 100)
    assert [r.result for r in got.orderBy("key", "emit_order").collect()] == [2, 4, 2, 2, 2, 2]
    with pytest.raises(Exception, match="retries wait"):
        loops.retry_concat(filled, "k", "i", "s", parity, lambda s: [(1, 1)] * s, "int", 3).collect()
    none = loops.retry_concat(filled, "k", "i", "s", parity, lambda s: [], "int", 3)
    assert [r.key for r in none.orderBy("key").collect()] == [0, 1]
    with pytest.raises(Exception, match="attempts"):
        loops.retry(df, "k", "i", "s", parity, lambda s: (2, s), "int", max_attempts=9).collect()


def test_unfold(spark):
    seeds = spark.createDataFrame([(27,)], "n long")

    def collatz(n):
        return None if n == 1 else (n // 2 if n % 2 == 0 else 3 * n + 1, n)

    def flow(n):
        if n == 1:
            raise StopIteration(1)
        return collatz(n)

    got = col(loops.unfold_flow_with(seeds, "n", collatz, "long"), "element", "step")
    assert len(got) == 111 and got[0] == 27 and got[-1] == 2 and max(got) == 9232
    assert len(col(loops.unfold_flow(seeds, "n", flow, "long"), "element", "step")) == 112
    sql = loops.unfold_sql(seeds, "n", "CASE WHEN state % 2 = 0 THEN state div 2 ELSE 3 * state + 1 END", "state <> 1", 300)
    assert col(sql, "element", "step") == got
    with pytest.raises(Exception, match="no end"):
        loops.unfold_flow_with(seeds, "n", lambda n: (n, n), "long", max_steps=50).collect()


def test_unfolds_are_dealt_to_all_tasks(spark):
    one = spark.range(40).coalesce(1)

    def down(n):
        if n == 0:
            raise StopIteration
        return n - 1, n

    for out in (loops.unfold_flow_with(one, "id", lambda n: (n - 1, n) if n else None, "long"), loops.unfold_flow(one, "id", down, "long")):
        rows = out.withColumn("task", F.spark_partition_id()).collect()
        assert sorted((r.seed, r.step, r.element) for r in rows) == sorted((n, k + 1, n - k) for n in range(40) for k in range(n))
        assert len({r.task for r in rows}) == 4


def test_feedback_each_is_dealt_to_all_tasks(spark):
    out = loops.feedback_each(spark.range(5000).coalesce(1), "id", lambda i: ([i], [i - 5000] if i >= 5000 else []), "long")
    rows = out.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.source, r.emit_order, r.element) for r in rows) == [(i, 1, i) for i in range(5000)]
    assert len({r.task for r in rows}) == 4


def test_unfold_batches(spark):
    big = 2**60 + 1
    seeds = spark.createDataFrame([(big,), (None,), (3,), (big,)], "n long").coalesce(1)
    up = loops.unfold_flow_with(seeds, "n", lambda s: (s + 1, s) if s != 3 and s < big + 40_000 else None, "long")
    whole = F.expr("sum(element - seed)").alias("more")
    assert [tuple(r) for r in up.groupBy("seed").agg(F.count("*"), F.max("step"), F.count_distinct("step"), F.max("element"), whole).collect()] == [
        (big, 80_000, 40_000, 40_000, big + 39_999, 40_000 * 39_999)]
    words = loops.unfold_flow_with(spark.createDataFrame([("ab",), ("",), ("abc",)], "w string"), "w", lambda w: (w[1:], w if len(w) > 1 else None) if w else None, "string")
    assert sorted((r.seed, r.step, r.element or "-") for r in words.collect()) == [("ab", 1, "ab"), ("ab", 2, "-"), ("abc", 1, "abc"), ("abc", 2, "bc"), ("abc", 3, "-")]


def test_unfold_limits(spark):
    def down(n):
        if n == 0:
            raise StopIteration(7)
        return n - 1, n

    assert col(loops.unfold_flow(spark.range(3, 4), "id", down, "long", max_steps=4, timeout_s=20.0), "element", "step") == [3, 2, 1, 7]
    with pytest.raises(Exception, match="no end after 3"):
        loops.unfold_flow(spark.range(3, 4), "id", down, "long", max_steps=3).collect()
    for most in (4096, 16_384, 20_000):
        exact = lambda s, most=most: (s + 1, s) if s < most else None
        assert loops.unfold_flow_with(spark.range(1), "id", exact, "long", max_steps=most).count() == most
        with pytest.raises(Exception, match="no end"):
            loops.unfold_flow_with(spark.range(1), "id", exact, "long", max_steps=most - 1).count()


def test_unfold_sql_beyond_the_row_limit_of_recursion(spark):
    half, more = "state div 2", "state > 0"
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")
    try:
        got = loops.unfold_sql(spark.range(3000), "id", half, more)
        assert got.dtypes == [("seed", "bigint"), ("step", "bigint"), ("element", "bigint")]
        want = {(i, k + 1, i >> k) for i in range(3000) for k in range(i.bit_length())}
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(want) and set(rows) == want
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_unfold_sql_rounds(spark):
    down = loops.unfold_sql(spark.createDataFrame([(0,), (1,), (31,), (32,), (33,), (100,), (100,), (None,)], "n int"), "n", "state - 1", "state > 0", 100)
    assert sorted(tuple(r) for r in down.collect()) == sorted((n, k + 1, n - k) for n in (1, 31, 32, 33, 100, 100) for k in range(n))
    with pytest.raises(Exception, match="no end after 99"):
        loops.unfold_sql(spark.range(100, 101), "id", "state - 1", "state > 0", 99).collect()
    assert loops.unfold_sql(spark.range(0), "id", "state - 1", "state > 0").count() == 0
    others = loops.unfold_sql(spark.range(1, 3), "id", "IF(step < 3, NULL, seed * 10)", "coalesce(state, 1) < 10", 5)
    assert sorted(map(str, (tuple(r) for r in others.collect()))) == [str((i, k, i if k == 1 else None)) for i in (1, 2) for k in (1, 2, 3)]
    assert loops.unfold_sql(spark.range(4), "id", "state - 1 + 0 * (10 div state)", "state > 0").count() == 6  # 10 div 0 is not reached


def test_metrics(spark):
    df = spark.range(1, 21).select(F.col("id").alias("seq"), (F.col("id") * 10).alias("a"))
    s = Stream(df, "seq", (), "a")
    assert metrics.timed(s).first().duration_us == 190
    assert metrics.timed(s.having(df.where("false"))).first().duration_us is None
    assert col(metrics.timed_interval_between(s, F.col("seq") % 5 == 0), "interval_us") == [50, 50, 50]
    seconds = []
    with pytest.raises(ZeroDivisionError):
        metrics.timed_action(lambda: 1 // 0, seconds.append)
    assert len(seconds) == 1
    starts = spark.createDataFrame([(1, 0), (1, 200), (1, 300)], "k int, t long")
    ends = spark.createDataFrame([(1, 100), (1, 350)], "k int, t long")
    assert col(metrics.latency_timer(starts, ends, ["k"], "t", "t", strict=True), "latency_us", "t") == [100, 50]


@pytest.mark.parametrize("walked", [0, 100_000])
def test_pages(spark, monkeypatch, walked):
    monkeypatch.setattr(paged, "WALKED", walked)
    pages = spark.createDataFrame([("first", [1, 2], "second"), ("second", [3, 4, 5], None)], "page_key string, items array<int>, next_key string")
    assert col(paged.paged_table(pages, "first").withColumn("o", F.col("page_no") * 100 + F.col("item_pos")), "item", "o") == [1, 2, 3, 4, 5]
    lists = spark.createDataFrame([(1, ["a", "b", "c"], 2), (2, ["d", "e"], 3), (3, [], 4), (4, ["x"], None)], "page_key int, items array<string>, next_key int")
    assert sorted(r.item for r in paged.paged_table(lists, 1).collect()) == list("abcde")
    assert paged.paged_table(lists, 9).count() == 0
    chain = spark.range(1, 300).selectExpr("id as page_key", "array(id * 10, id * 10 + 1) as items", "id + 1 as next_key")
    assert [r.item for r in paged.paged_table(chain, 50).orderBy("page_no", "item_pos").collect()] == [10 * i + k for i in range(50, 300) for k in (0, 1)]
    loop = spark.createDataFrame([(1, [1], 2), (2, [2], 1)], "page_key int, items array<int>, next_key int")
    with pytest.raises(RuntimeError):
        paged.paged_table(loop, 1, max_pages=10)
    even = paged.paged_source(spark, "even_pages", "n int", 0, lambda k: ([(4 * k,), (4 * k + 2,)], k + 1 if k < 3 else None))
    assert sorted(r.n for r in even.collect()) == list(range(0, 16, 2))


def zipped(names, data):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, d in zip(names, data):
            z.writestr(n, d)
    return out.getvalue()


@pytest.mark.parametrize("chunk,chunks", [(1024, 3), (256, 12), (250, 15)])
def test_zip(spark, chunk, chunks):
    inner = zipped(["b.txt", "dir/", "c.txt"], [b"b" * 1024, b"", b"c" * 1024])
    outer = zipped(["a.txt", "in.zip", "empty.txt"], [b"a" * 1024, inner, b""])
    df = spark.createDataFrame([("x", outer), ("none", None), ("empty", zipped([], []))], "path string, content binary")
    out = archives.zip_entries(df, chunk)
    assert out.count() == chunks and out.agg(F.sum(F.octet_length("chunk"))).first()[0] == 3072
    assert {r.name for r in out.collect()} == {"a.txt", "b.txt", "c.txt"}


def test_files(spark, tmp_path):
    before = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, mtime_us long, size long")
    after = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "path string, mtime_us long, size long")
    assert {(r.path, r.change) for r in files.directory_changes(before, after).collect()} == {("b", "Modification"), ("c", "Deletion"), ("d", "Creation")}
    files.register(spark)
    path = tmp_path / "log"
    path.write_bytes(b"a\nb\nc\nd")
    rows = spark.read.format("file_tail").option("path", str(path)).option("maxChunkSize", 3).load().orderBy("position").collect()
    assert [bytes(r.chunk) for r in rows] == [b"a\nb", b"\nc\n", b"d"]
    df = spark.createDataFrame([(1, b"abcdefg"), (2, b""), (3, None)], "k int, c binary")
    assert [bytes(r.chunk) for r in files.byte_chunks(df, "k", "c", 2, 2).orderBy("position").collect()] == [b"cd", b"ef", b"g"]
    with pytest.raises(Exception, match="readable"):
        spark.read.format("file_tail").option("path", str(tmp_path)).load().collect()


def test_file_streams(spark, tmp_path):
    files.register(spark)
    path, watched = tmp_path / "log", tmp_path / "dir"
    path.write_bytes(b"a\n")
    os.mkdir(watched)
    tail = spark.readStream.format("file_tail").option("path", str(path)).load().writeStream.format("memory").queryName("tail").start()
    changes = spark.readStream.format("directory_changes").option("path", str(watched)).load().writeStream.format("memory").queryName("changes").start()
    try:
        tail.processAllAvailable()
        changes.processAllAvailable()
        with open(path, "ab") as f:
            f.write(b"b\n")
        (watched / "new").write_text("1")
        tail.processAllAvailable()
        changes.processAllAvailable()
        (watched / "new").unlink()
        changes.processAllAvailable()
    finally:
        tail.stop()
        changes.stop()
    assert b"".join(bytes(r.chunk) for r in spark.sql("select * from tail order by position").collect()) == b"a\nb\n"
    assert [r.change for r in spark.sql("select * from changes").collect()][:1] == ["Creation"]
    assert spark.sql("select * from changes where change = 'Deletion'").count() == 1


def test_repeat_eval(spark):
    assert sorted(r.value for r in repeat_eval.repeat_eval(spark, 10, F.col("id")).collect()) == list(range(10))
    assert repeat_eval.repeat_eval(spark, 5, lambda: 7, "int").where("value = 7").count() == 5
    handle = repeat_eval.repeat_eval_stream(spark, F.rand(), 10, lambda df: df.writeStream.format("noop").start())
    assert handle.cancel() is True and handle.cancel() is False and handle.is_cancelled
