"""Streaming forms give the rows of the batch forms."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import ordered, timing
from millrace.operators.stream import Stream
from millrace.streaming import stateful as st
from millrace.streaming.valve import CLOSE, OPEN, ValveSwitch

ROWS = [(u, 10 * i + u, (7 * i * i + 3 * u) % 11 + 13 * i, "abab"[(i // 2 + u) % 4], 1 + i % 3, 5.0 if i % 4 == 0 else None) for u in range(3) for i in range(20)]
SCHEMA = "user long, id long, a long, kind string, cost long, amount double"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in"))
    for part in range(2):  # two files, two micro-batches, in order
        df = spark.createDataFrame([r for r in ROWS if (r[1] >= 100) == bool(part)], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, source, machine, tmp_path, order="id"):
    df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    name = f"t{abs(hash(str(tmp_path)))}"
    q = st.stateful(df, ["user"], order, machine).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return {tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in spark.sql(f"select * from {name}").collect()}


def batch(spark, source):
    return Stream(spark.read.parquet(source), "id", ("user",), "a")


def test_accumulate(spark, source, tmp_path):
    got = run(spark, source, st.accumulate("cost", "id", lambda a, x: a + x, 0, "long"), tmp_path)
    assert got == {tuple(r) for r in ordered.accumulate(batch(spark, source), "cost", 0).select("user", "id", "acc").collect()}


def test_sample(spark, source, tmp_path):
    got = run(spark, source, st.sample_nth(3, "id"), tmp_path)
    assert got == {tuple(r) for r in ordered.sample_nth(batch(spark, source), 3).select("user", "id").collect()}


@pytest.mark.parametrize("opened", [True, False])
def test_pulse(spark, source, tmp_path, opened):
    got = run(spark, source, st.pulse(40, "a", "id", opened), tmp_path)
    assert got == {tuple(r) for r in timing.pulse(batch(spark, source), 40, opened).select("user", "id", "emit_us").collect()}


def test_delay(spark, source, tmp_path):
    got = run(spark, source, st.delay_by("cost", "a", "id"), tmp_path)
    assert got == {tuple(r) for r in timing.delay_by(batch(spark, source), "cost").select("user", "id", "emit_us").collect()}


def test_runs(spark, source, tmp_path):
    got = run(spark, source, st.accumulate_while_unchanged("kind", "id", "id", "long", 2), tmp_path)
    want = ordered.accumulate_while_unchanged(batch(spark, source), "kind", "id", 2).orderBy("user", "first_order").collect()
    closed = {(r.user, r.first_order, tuple(r.elements), r.n) for r in want} - {(r.user, r.first_order, tuple(r.elements), r.n) for u in range(3) for r in [[x for x in want if x.user == u][-1]]}
    assert {(u, f, tuple(e), n) for u, f, e, n in got} == closed


def machine_rows(machine, rows):
    state, out = machine.begin(), []
    for r in rows:
        state, more = machine.step(state, r)
        out += more
    return out + list(machine.end(state))


@pytest.mark.parametrize("eager", [True, False])
def test_time_window(spark, source, eager):
    s = batch(spark, source)
    want = timing.time_window(s, 30, eager).groupBy("user", "_cell", "alone", "emit_us").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("f"))
    want = {(r.user, r.emit_us, r.n, r.f) for r in want.collect()}
    rows = pd.DataFrame(ROWS, columns=["user", "id", "a", "kind", "cost", "amount"]).sort_values("id").to_dict("records")
    got = {(u, *x) for u in range(3) for x in machine_rows(st.time_window(30, "a", "id", eager), [r for r in rows if r["user"] == u])}
    assert got == want


def test_throttle_and_valve():
    rows = [{"id": 1, "cost": 5, "amount": None}, {"id": 0, "cost": 0, "amount": 8}, {"id": 2, "cost": 5, "amount": None}, {"id": 0, "cost": 0, "amount": 2}]
    assert machine_rows(st.token_throttle("id", "cost", "amount"), rows) == [(1, 5), (2, 5)]
    rows = [{"id": 1, "o": None}, {"id": 0, "o": 0}, {"id": 2, "o": None}, {"id": 3, "o": None}, {"id": 0, "o": 1}, {"id": 4, "o": None}]
    assert machine_rows(st.valve("id", "o"), rows) == [(1,), (2,), (3,), (4,)]


def test_valve_switch(spark):
    switch = ValveSwitch(lambda: spark.readStream.format("rate").load().writeStream.format("noop").start(), CLOSE)
    assert switch.mode == CLOSE and switch.flip(CLOSE) is False
    assert switch.flip(OPEN) is True and switch.mode == OPEN and switch.flip(OPEN) is False
    assert switch.flip(CLOSE) is True
    switch.complete()
    with pytest.raises(RuntimeError):
        switch.mode


def closed(df, order):
    """Batch rows without the last of each user, which a stream still holds."""
    rows = df.orderBy("user", order).collect()
    return {tuple(tuple(x) if isinstance(x, list) else x for x in r) for r, after in zip(rows, rows[1:]) if r.user == after.user}


def test_runs_with_ticks(spark, source, tmp_path):
    got = run(spark, source, st.accumulate_while_unchanged("kind", "id", "id", "long", 3, 40, "a"), tmp_path)
    want = ordered.accumulate_while_unchanged(batch(spark, source), "kind", "id", 3, 40).select("user", "first_order", "elements", "n")
    assert got == closed(want, "first_order")


def test_linear_delay(spark, source, tmp_path):
    df = lambda s: timing.delay_linear(s, 7, F.col("kind") == "a", 3, 20)
    want = {tuple(r) for r in df(batch(spark, source)).select("user", "id", "emit_us").collect()}
    rows = [dict(zip(["user", "id", "a", "kind"], r)) | {"flag": r[3] == "a"} for r in sorted(ROWS, key=lambda r: r[1])]
    machine = st.delay_linear(7, "flag", "a", "id", 3, 20)
    assert {(u, *x) for u in range(3) for x in machine_rows(machine, [r for r in rows if r["user"] == u])} == want


def test_rate_limiter(spark, source, tmp_path):
    got = run(spark, source, st.interval_rate_limiter(30, 2, "a", "id", "id", "long"), tmp_path)
    want = timing.interval_rate_limiter(batch(spark, source), 30, 2, "id").select("user", "first_order", "elements", "n", "emit_us")
    rows = {tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in want.collect()}
    assert closed(want, "first_order") <= got <= rows


@pytest.mark.parametrize("size", [1, 2, 5])
def test_keep_alive(spark, source, size):
    s = batch(spark, source)
    s = s.having(s.df.select("user", "id", "a", F.array("id", F.col("id") + 1, F.col("id") + 2).alias("items")))
    want = timing.keep_alive_concat(s, size, 9, "items", lambda x: [[i] for i in x]).orderBy("user", "emit_order").collect()
    rows = [{"user": r[0], "id": r[1], "a": r[2], "items": [r[1], r[1] + 1, r[1] + 2]} for r in sorted(ROWS, key=lambda r: r[1])]
    machine = st.keep_alive_concat(size, 9, "a", "items", lambda x: [[i] for i in x], "array<long>")
    got = [(u, t, list(x)) for u in range(3) for t, x in machine_rows(machine, [r for r in rows if r["user"] == u])]
    assert got == [(r.user, r.emit_us, list(r["items"])) for r in want]


def test_random_sample(spark, source, tmp_path):
    got = run(spark, source, st.sample_random(4, "id", 9), tmp_path)
    assert got == {tuple(r) for r in ordered.sample_random(batch(spark, source), 4, 9).select("user", "id").collect()}
    with pytest.raises(ValueError):
        machine_rows(st.sample_steps(lambda k: 0, "id"), [{"id": 1}])


def test_intervals(spark, source, tmp_path):
    from millrace.operators import metrics

    got = run(spark, source, st.timed_interval_between("amount", "a", "id"), tmp_path)
    matching = F.col("amount").isNotNull()
    want = {tuple(r) for r in metrics.timed_interval_between(batch(spark, source), matching).select("user", "id", "interval_us").collect()}
    assert got == want and len(got) > 3


def test_last_element_and_index_merge():
    assert machine_rows(st.last_element("v", "id", "long"), [{"id": 1, "v": 5}, {"id": 2, "v": 6}]) == [(2, 6)]
    assert machine_rows(st.last_element("v", "id", "long"), []) == []
    machine = st.merge_by_index(2, "i", "x")
    rows = [{"i": 0, "x": 1}, {"i": 0, "x": 4}, {"i": 1, "x": 0}, {"i": 1, "x": 6}, {"i": 1, "x": None}, {"i": 0, "x": 9}]
    state, seen = machine.begin(), []
    for r in rows:
        state, out = machine.step(state, r)
        seen.append([x for x, _ in out])
    assert seen == [[], [], [0], [1, 4], [], [6, 9]]
    for bad in ([(0, 3), (0, 2)], [(0, -1)], [(0, 1), (1, 1)]):
        with pytest.raises(ValueError):
            machine_rows(st.merge_by_index(2, "i", "x"), [{"i": i, "x": x} for i, x in bad])
