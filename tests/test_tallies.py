"""Longest gaps and exact quantiles of windows, against their SQL and brute force."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from rillflow import queries
from rillflow.operators import tallies

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Windows of 2,500 rows, users with few rows, ties, nulls in every column."""
    r, d = random.Random(8), str(tmp_path_factory.mktemp("tallies"))
    some = lambda v: None if r.random() < 0.02 else v
    rows = [(i, some(T0 + dt.timedelta(seconds=r.randrange(172_800), microseconds=r.randrange(3))), some(r.randrange(400)), some(r.choice("ab")), some(r.choice([r.gauss(0, 1), r.randrange(9) / 2]))) for i in range(10_000)]
    df = spark.createDataFrame(rows, "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE")
    df.repartition(70).write.parquet(f"{d}/events.parquet")  # two batches of a stream
    return d


@pytest.mark.parametrize("name", ["window_longest_gap", "stream_window_longest_gap", "window_quantiles", "stream_window_quantiles"])
def test_windows_match_their_sql(spark, folder, name):
    expected = duckdb.connect().execute(f"WITH events AS (FROM '{folder}/events.parquet/*.parquet') SELECT * FROM ({queries.SQL[name]}) WHERE window_start IS NOT NULL").fetchall()
    found = [tuple(r) for r in queries.QUERIES[name](spark, folder).collect()]
    assert len(found) > 15 and sorted(found, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("name", queries.WINDOW_TALLIES)
def test_no_python_for_each_group(spark, folder, name):
    plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "Python" not in plan


@pytest.mark.parametrize("most", [tallies.MOST, 50])
def test_quantiles_by_brute_force(spark, most):
    r = random.Random(2)
    rows = [(k, r.choice([r.random(), r.randrange(4) / 4, float("nan")]), i) for k, n in (("a", 700), (None, 300), ("one", 1)) for i in range(n)] + [("none", None, 0), ("a", None, 1)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE, i LONG").repartition(5)
    percents = (0, 0.1, 25, 50, 99.9, 100)
    expected = set()
    for k in ("a", None, "one"):
        own = sorted((v for x, v, _ in rows if x == k and v is not None), key=lambda v: (v != v, v))
        expected |= {(k, float(p), repr(own[max(1, -(-round(p * 10) * len(own) // 1000)) - 1])) for p in percents}
    found = tallies.tallied(df, ["k"], tallies.Quantiles("v", percents, most)).collect()
    assert {(x["k"], x["percent"], repr(x["value"])) for x in found} == expected and len(found) == len(expected)
    whole = tallies.tallied(df.filter("v < 2"), [], tallies.Quantiles("v", (50,), most)).collect()
    own = sorted(v for _, v, _ in rows if v is not None and v < 2)
    assert [tuple(x) for x in whole] == [(50.0, own[-(-len(own) // 2) - 1])]


def test_gaps_by_brute_force(spark):
    r = random.Random(3)
    rows = [(k, None if r.random() < 0.03 else T0 + dt.timedelta(seconds=r.choice([r.randrange(9000), 600, 4000]))) for k in (1, 2, None) for _ in range(60)] + [(9, T0)]
    df = spark.createDataFrame(rows, "k LONG, ts TIMESTAMP_NTZ").repartition(4)
    expected = set()
    for k in (1, 2, None, 9):
        times = sorted(t for x, t in rows if x == k and t)
        gap, start = max(((b - a, T0 - a) for a, b in zip(times, times[1:])), default=(dt.timedelta(0), None))
        expected |= {(k, T0 - start, gap.total_seconds())} if gap.total_seconds() >= 300 else set()
    assert expected and {tuple(x) for x in tallies.tallied(df, ["k"], tallies.LongestGaps("ts", 300)).collect()} == expected
    assert tallies.tallied(df.limit(0), ["k"], tallies.LongestGaps("ts", 300)).agg(F.count(F.lit(1))).first()[0] == 0
