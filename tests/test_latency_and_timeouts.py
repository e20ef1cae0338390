"""Latency around a flow, time-outs of flows, totals of archives, bounded batches of a growing file."""

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.operators import loops, metrics, timing
from millrace.operators.stream import Stream
from millrace.sources import archives, files


def test_latency_of_a_flow_that_delays_and_drops(spark):
    """+100, a dropped second element, +50."""
    df = spark.createDataFrame([(1, 0), (2, 1000), (3, 2000)], "seq long, at long")
    s = Stream(df, "seq", (), "at")
    flow = lambda x: x.df.where("seq != 2").withColumn("emit_us", F.col("at") + F.when(F.col("seq") == 1, 100).otherwise(50)).drop("at")
    assert {(r.seq, r.latency_us) for r in metrics.measure_latency(s, flow, "seq").collect()} == {(1, 100), (3, 50)}
    got = []
    out = metrics.measure_latency(s, flow, "seq", to=lambda latencies: got.extend(tuple(r) for r in latencies.collect()))
    assert sorted(got) == [(1, 100), (3, 50)] and out.columns == ["seq", "emit_us"] and out.count() == 2
    extra = lambda x: x.df.select((F.col("seq") + 2).alias("seq"), F.col("at").alias("emit_us"))
    assert {(r.seq, r.latency_us) for r in metrics.measure_latency(s, extra, "seq").collect()} == {(3, -2000), (4, None), (5, None)}
    assert metrics.measure_latency(s.having(df.where("false")), flow, "seq").count() == 0
    with pytest.raises(ValueError):
        metrics.measure_latency(Stream(df, "seq"), flow, "seq")


def test_latency_of_a_real_flow(spark):
    s = Stream(spark.range(5).selectExpr("id as seq", "0L as at"), "seq", (), "at")
    got = {r.seq: r.latency_us for r in metrics.measure_latency(s, lambda x: timing.delay_fixed(x, 10).drop("at"), "seq").collect()}
    assert got == {i: 10 * (i + 1) for i in range(5)}


def test_wall_clock_of_each_call(spark):
    def slow(x):
        time.sleep(0.02 * x)
        return None if x == 2 else x * 10

    rows = {r.id: r for r in metrics.map_measured(spark.range(4), "id", slow, "long").collect()}
    assert set(rows) == {0, 1, 3} and all(r.result == 10 * i and 20_000 * i <= r.latency_us < 20_000 * i + 500_000 for i, r in rows.items())


def test_timeouts(spark):
    def flow(x):
        time.sleep(30 if x == 1 else 0)
        return x

    df = spark.createDataFrame([(0, 1, 1), (1, 2, 5)], "k long, x long, s long")
    got = {r.key: (r.ok, r.result, r.error, r.attempts) for r in loops.retry(df, "k", "x", "s", flow, lambda s: (s + 1, s + 1) if s < 2 else None, "long", timeout_s=0.5).collect()}
    assert got == {0: (True, 2, None, 2), 1: (True, 2, None, 1)}
    failed = loops.retry(df.where("k = 0"), "k", "x", "s", flow, lambda s: None, "long", timeout_s=0.5).first()
    assert not failed.ok and "0.5 s" in failed.error
    spark.conf.set(loops.RETRY_TIMEOUT, "0.5")
    try:
        assert "0.5 s" in loops.retry(df.where("k = 0"), "k", "x", "s", flow, lambda s: None, "long").first().error
    finally:
        spark.conf.unset(loops.RETRY_TIMEOUT)
    many = {(r.key, r.ok, r.result) for r in loops.retry_concat(df, "k", "x", "s", flow, lambda s: [(7, s), (8, s)], "long", 10, timeout_s=0.5).collect()}
    assert many == {(0, True, 7), (0, True, 8), (1, True, 2)}

    def step(x):
        if x == 3:
            time.sleep(30)
        return None if x > 5 else (x + 1, x)

    with pytest.raises(Exception, match="no answer within"):
        loops.unfold_flow_with(spark.range(1), "id", step, "long", timeout_s=0.5).collect()
    assert loops.unfold_flow_with(spark.range(4, 5), "id", step, "long", timeout_s=5.0).count() == 2


def test_views_of_recursive_queries_are_dropped(spark):
    rows = loops.unfold_sql(spark.range(1, 4), "id", "state - 1", "state > 0").collect()
    assert sorted((r.seed, r.step, r.element) for r in rows) == [(1, 1, 1), (2, 1, 2), (2, 2, 1), (3, 1, 3), (3, 2, 2), (3, 3, 1)]
    assert not [t for t in spark.catalog.listTables() if t.isTemporary and "seeds" in t.name]


def zipped(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in names.items():
            z.writestr(name, body)
    return out.getvalue()


def test_total_bytes_of_archives_on_disk(spark, tmp_path):
    """Read through the source, a nested archive included."""
    (tmp_path / "a.zip").write_bytes(zipped({"x.txt": b"x" * 3000, "in.zip": zipped({"y.txt": b"y" * 500}), "empty": b""}))
    (tmp_path / "b.zip").write_bytes(zipped({"z": b"z" * 10}))
    (tmp_path / "none.zip").write_bytes(zipped({}))
    chunks = archives.zip_source(spark, f"file://{tmp_path}", chunk_bytes=1024)
    assert {(r.name, r.chunk_no): bytes(r.chunk) for r in chunks.collect()} == {("x.txt", 0): b"x" * 1024, ("x.txt", 1): b"x" * 1024, ("x.txt", 2): b"x" * 952, ("y.txt", 0): b"y" * 500, ("z", 0): b"z" * 10}
    assert {r.archive.rsplit("/", 1)[1]: r.total_bytes for r in archives.total_bytes(chunks).collect()} == {"a.zip": 3500, "b.zip": 10}


def test_a_long_backlog_comes_in_bounded_batches(spark, tmp_path):
    path = tmp_path / "log"
    path.write_bytes(bytes(range(256)) * 100)
    files.register(spark)
    seen = []

    def take(df, _):
        seen.append(sorted((r.position, bytes(r.chunk)) for r in df.collect()))

    q = spark.readStream.format("file_tail").option("path", str(path)).option("maxChunkSize", 1000).option("maxBatchBytes", 5500).load().writeStream.foreachBatch(take).start()
    try:
        end = time.time() + 60
        while sum(len(c) for b in seen for _, c in b) < 25600 and time.time() < end:
            time.sleep(0.2)
    finally:
        q.stop()
    batches = [b for b in seen if b]
    assert all(sum(len(c) for _, c in b) <= 5000 for b in batches) and len(batches) >= 6
    assert b"".join(c for b in batches for _, c in b) == path.read_bytes()
