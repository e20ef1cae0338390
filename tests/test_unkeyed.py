"""One sequence without keys gives what one key gives, by prefix scans and without a task that holds all rows."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import metrics, ordered, routing, timing
from millrace.operators.stream import Stream, over
from millrace.plans.prefix import scan

R = random.Random(4)
ROWS = [(i * 3, R.randrange(1000) + 700 * i, R.choice(["a", "a", "b", None]), R.choice([None, 1, 2, 5])) for i in range(1500)]


@pytest.fixture(scope="module")
def streams(spark):
    df = spark.createDataFrame(R.sample(ROWS, len(ROWS)), "seq long, at long, kind string, v long").repartition(4).withColumn("k", F.lit(1))
    return Stream(df, "seq", (), "at"), Stream(df, "seq", ("k",), "at")


OPERATORS = {
    "sum": lambda s: ordered.accumulate(s, "v"),
    "sum from": lambda s: ordered.accumulate(s, "v", 10),
    "max": lambda s: ordered.accumulate(s, "v", how="max"),
    "min": lambda s: ordered.accumulate(s, "v", how="min"),
    "count": lambda s: ordered.accumulate(s, "v", how="count"),
    "runs": lambda s: ordered.accumulate_while_unchanged(s, "kind", "seq").drop("k"),
    "runs of three": lambda s: ordered.accumulate_while_unchanged(s, "kind", "v", 3, 2000).drop("k"),
    "nth": lambda s: ordered.sample_nth(s, 7),
    "random": lambda s: ordered.sample_random(s, 9, 3),
    "steps": lambda s: ordered.sample_steps(s, s.df.sparkSession.range(1, 40).selectExpr("id as step_no", "id as step")),
    "last": lambda s: ordered.last_element(s.having(s.df.withColumn("ok", F.col("seq") < 3000)), ["seq", "kind"], "ok").drop("k"),
    "delay": lambda s: timing.delay_by(s, F.col("v") * 300),
    "linear": lambda s: timing.delay_linear(s, 100, F.col("kind") == "a", 50, 400),
    "pulse": lambda s: timing.pulse(s, 650),
    "interval": lambda s: metrics.timed_interval_between(s, F.col("kind") == "b"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_as_one_key(streams, name):
    got, want = ([str(r) for r in x.orderBy(x.columns[0]).select(sorted(x.columns)).collect()] for x in map(OPERATORS[name], streams))
    assert sorted(got) == sorted(want) and len(got) > 0


@pytest.mark.parametrize("name", ["sum", "nth", "delay", "pulse", "runs", "interval", "linear"])
def test_no_task_holds_all_rows(streams, name):
    """The only single partitions are those of the carried table, a row for each range."""
    plan = OPERATORS[name](streams[0])._jdf.queryExecution().executedPlan().toString()
    for part in plan.split("Exchange SinglePartition")[1:]:
        assert "_k__range" in part[:1500]
    assert "hashpartitioning(_range" in plan


def test_ties_across_ranges_and_empty_streams(spark):
    df = spark.createDataFrame([(None, 1), (1, 2), (2, None), (3, 4)], "o long, v long")
    rows = scan(df, "o", {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "b": ("lag", F.col("v"))}).orderBy("o").collect()
    assert [(r.s, r.n, r.b.value if r.b else "first") for r in rows] == [(1, 1, "first"), (3, 2, 1), (3, 2, 2), (7, 3, None)]
    assert scan(df.where("false"), "o", {"s": ("sum", F.col("v"))}).count() == 0


def test_merge_by_index_without_a_task_for_each_input(spark):
    r = random.Random(2)
    dealt = [[] for _ in range(4)]
    for i in range(2000):
        if r.random() < 0.8:
            dealt[r.randrange(4)].append(i)
    inputs = [spark.createDataFrame([(i, 10 * n) for n, i in enumerate(x)], "idx long, place long") for x in dealt]
    merged = routing.merge_by_index(inputs, "idx", "place")
    assert "hashpartitioning(_input#" not in merged._jdf.queryExecution().executedPlan().toString()
    rows = merged.orderBy("emit_position").collect()
    assert [x.idx for x in rows] == sorted(i for x in dealt for i in x) and [x.emit_position for x in rows] == list(range(1, len(rows) + 1))
    for bad in ([(5, 0), (3, 1)], [(-1, 0)], [(None, 0)], [(7, 0), (7, 1)]):
        with pytest.raises(Exception, match="index"):
            routing.merge_by_index([inputs[0].where("false"), spark.createDataFrame(bad, "idx long, place long")], "idx", "place").collect()
    with pytest.raises(Exception, match="twice"):
        routing.merge_by_index([spark.createDataFrame([(4, 0)], "idx long, place long")] * 2, "idx", "place").collect()


def test_transform_and_apply(streams):
    plain, keyed = streams
    want = {(r.seq, r.emit_us) for r in timing.pulse(keyed, 650).collect()}
    assert {(r.seq, r.emit_us) for r in keyed.df.transform(over(timing.pulse, 650, order_by="seq", by=["k"], arrival="at")).collect()} == want
    assert {(r.seq, r.emit_us) for r in keyed.apply(timing.pulse, 650).collect()} == want
