"""Every query against its SQL on the smallest tables, and the entry point's contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans.catalogue import QUERIES, SQL
from millrace.plans.prefix import global_running

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, other, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    if name not in SQL:
        return
    want = other.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    x, y = (d[columns].astype(str).sort_values(columns).reset_index(drop=True) for d in (got, want))
    assert x.equals(y)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_prefix_scan(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 as o", "id as v")
    rows = global_running(df, "o", {"s": "v"}, "p").orderBy("o").collect()
    total = 0
    for i, r in enumerate(rows):
        total += r.v
        assert (r.p, r.s) == (i + 1, total)
