"""The interval join against DuckDB's range join: short and very long intervals, hot bins, awkward rows."""

import random

import duckdb
import pytest

from quillspark.operators.intervals import points_in_intervals


def tables(seed):
    r = random.Random(seed)
    points = [(r.choice([1, 2, None]), r.choice([r.randint(-5000, 5000), 77, 10**12, None]), k) for k in range(400)]
    intervals = []
    for k in range(150):
        lo = r.choice([r.randint(-6000, 6000), 70])
        intervals.append((r.choice([1, 2, 3, None]), lo, lo + r.choice([0, -5, 1, 7, 100, 5000, 2**40]), k))
    intervals += [(1, None, 5, 900), (1, 5, None, 901), (2, 78, 79, 902), (2, -(2**45), 2**45, 903)]
    return points, intervals


@pytest.mark.parametrize("seed,width,hot", [(1, 1024, 100_000), (2, 1, 5), (3, 64, 3)])
def test_equals_a_range_join(spark, seed, width, hot):
    points, intervals = tables(seed)
    p = spark.createDataFrame(points, "doc int, at bigint, pid int")
    i = spark.createDataFrame(intervals, "doc int, lo bigint, hi bigint, iid int")
    df = points_in_intervals(p, i, ["doc"], "at", "lo", "hi", width, hot)
    got = sorted((x["pid"], x["iid"]) for x in df.collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE p (doc INT, at_ BIGINT, pid INT)")
    con.execute("CREATE TABLE i (doc INT, lo BIGINT, hi BIGINT, iid INT)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?)", points)
    con.executemany("INSERT INTO i VALUES (?, ?, ?, ?)", intervals)
    assert got == sorted(con.execute("SELECT pid, iid FROM p JOIN i ON p.doc = i.doc AND at_ >= lo AND at_ < hi").fetchall()) and len(got) > 500
    assert df.columns == ["doc", "at", "pid", "lo", "hi", "iid"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_long_interval_is_two_rows(spark):
    """An interval as long as all bins together doesn't multiply, and empty tables join to nothing."""
    i = spark.createDataFrame([(1, 0, 2**50, 1)], "doc int, lo bigint, hi bigint, iid int")
    p = spark.range(1000).selectExpr("1 AS doc", "id * 1000000007 AS at")
    assert points_in_intervals(p, i, ["doc"], "at", "lo", "hi").count() == 1000
    assert points_in_intervals(p, i.where("false"), ["doc"], "at", "lo", "hi").count() == 0 == points_in_intervals(p.where("false"), i, ["doc"], "at", "lo", "hi").count()
