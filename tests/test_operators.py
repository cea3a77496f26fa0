import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.functions import records, smoothing
from rillflow.operators import aggregates, exchange, filters, joins, maps

T0 = dt.datetime(2024, 1, 1)


def test_first_by_key_drops_null_keys(spark):
    rows = [(k, t, v) for t, v in ((1, "b"), (0, "a")) for k in range(10)] + [(None, 0, "n")]
    found = filters.first_by_key(spark.createDataFrame(rows, "key INT, t INT, v STRING"), "key", ["t"]).collect()
    assert sorted((r["key"], r["v"]) for r in found) == [(k, "a") for k in range(10)]


def test_predicates(spark):
    df = spark.createDataFrame([(-3, "b"), (2, ""), (5, None), (7, "éa"), (8, "Bx")], "n INT, p STRING")
    assert [r["n"] for r in df.filter(filters.odd(F.col("n"))).collect()] == [-3, 5, 7]
    assert [r["n"] for r in df.filter(filters.even_initial(F.col("p"))).collect()] == [-3, 8]


def test_hash_sample_is_stable_and_about_a_fifth(spark):
    df = spark.range(10000)
    a, b = ({r["id"] for r in filters.hash_sample(x, "id").collect()} for x in (df, df.repartition(7)))
    assert a == b and 1700 < len(a) < 2300


def test_leader_ties(spark):
    df = spark.createDataFrame([("w", 1, 5), ("w", 2, 7), ("w", 3, 7), ("x", 9, 1)], "g STRING, item LONG, n LONG")
    assert sorted(map(tuple, filters.leader(df, ["g"], "n", "item").collect())) == [("w", 2, 7), ("x", 9, 1)]


def test_words_keep_line_feeds(spark):
    df = spark.createDataFrame([(1, "a, b.c\nd  e"), (2, ""), (3, None)], "id INT, s STRING")
    assert [r["word"] for r in maps.to_words(df, "s", "id").collect()] == ["a", "b", "c\nd", "e"]


def test_joins_of_small_events(spark):
    a = spark.createDataFrame([(1, 1), (10, 1), (100, 0)], "ak INT, av INT")
    b = spark.createDataFrame([(10, 1), (1000, 2), (10000, 1)], "bk INT, bv INT")
    found = joins.join_on(a, b, "av", "bv").select((F.col("ak") + F.col("bk")).alias("key")).collect()
    assert sorted(r["key"] for r in found) == [11, 20, 10001, 10010]


def test_band_join_is_the_theta_join(spark):
    r = random.Random(1)
    left, right = ([(i, r.randrange(-200, 200)) for i in range(80)] for _ in range(2))
    found = joins.band_join(spark.createDataFrame(left, "l LONG, lv LONG"), spark.createDataFrame(right, "r LONG, rv LONG"), "lv", "rv", 13)
    assert sorted((x["l"], x["r"]) for x in found.collect()) == sorted((i, j) for i, a in left for j, b in right if abs(a - b) <= 13)


def test_join_near_is_the_plain_join(spark):
    r = random.Random(2)
    rows = lambda: [(i, r.randrange(3), T0 + dt.timedelta(seconds=r.randrange(4000))) for i in range(60)]
    left, right = rows(), rows()
    found = joins.join_near(spark.createDataFrame(left, "a INT, k INT, t TIMESTAMP"), spark.createDataFrame(right, "b INT, l INT, u TIMESTAMP"), "k", "l", "t", "u", 300)
    assert sorted((x["a"], x["b"]) for x in found.collect()) == sorted((a, b) for a, k, t in left for b, l, u in right if k == l and abs((t - u).total_seconds()) <= 300)
    assert set(found.columns) == {"a", "k", "t", "b", "l", "u"}


def test_join_within_is_strict(spark):
    bids = spark.createDataFrame([(1, t) for t in range(5)], "k INT, t INT")
    sale = spark.createDataFrame([(1, 1, 4)], "id INT, a INT, b INT")
    assert sorted(r["t"] for r in joins.join_within(bids, sale, "k", "id", "t", F.col("a"), F.col("b")).collect()) == [2, 3]


def test_windows(spark):
    rows = [(T0 + dt.timedelta(seconds=s), w, c) for s, w, c in ((0, "a", 1), (0, "a", 2), (1, "a", 5), (0, "z", 0))]
    df = spark.createDataFrame(rows, "t TIMESTAMP_NTZ, w STRING, c INT")
    found = aggregates.sum_by_window(df, ["w"], "c", "t", "1 second").collect()
    assert sorted((r["window_start"], r["w"], r["total"], r["n"]) for r in found) == [(T0, "a", 3, 2), (T0 + dt.timedelta(seconds=1), "a", 5, 1)]
    slid = aggregates.count_by_window(df, [], "t", "2 seconds", "1 second").collect()
    assert sorted((r["window_start"].second, r["n"]) for r in slid) == [(0, 4), (1, 1), (59, 3)]


def test_highest_and_average(spark):
    df = spark.createDataFrame([(1, 5.25, 2), (1, 9.5, 4), (1, 9.5, 3), (2, 1.0, 1)], "k INT, v DOUBLE, id INT")
    assert sorted(map(tuple, aggregates.highest(df, "k", "v", "id").collect())) == [(1, 9.5, 3), (2, 1.0, 1)]
    assert sorted((r["k"], r["avg_amount"], r["n"]) for r in aggregates.average_of(df, "k", "v", "id").collect()) == [(1, 8.0833, 3), (2, 1.0, 1)]


def test_placement(spark):
    df = spark.createDataFrame([(7,), (-7,), (None,), (-2147483648,)], "k INT")
    found = exchange.place(df, "k", 3).collect()
    assert sorted((r["k"] is None, r["k"] or 0, r["shard"]) for r in found) == [(False, -2147483648, 2), (False, -7, 1), (False, 7, 1), (True, 0, 0), (True, 0, 1), (True, 0, 2)]


def test_records_round_trip(spark):
    df = spark.createDataFrame([(None, T0 + dt.timedelta(microseconds=120000)), (4, T0)], "k INT, t TIMESTAMP")
    out = records.output_record(df, "k", "t", F.col("t") + F.expr("INTERVAL 1 SECOND"), F.lit(3))
    assert [tuple(r) for r in out.collect()] == [(0, "2024010100000012$2024010100000112$3"), (4, "20240101000000$20240101000001$3")]
    back = records.parse_record(out).collect()
    assert back[0]["event_time"] == T0 + dt.timedelta(microseconds=120000) and back[1]["output_time"] == T0 + dt.timedelta(seconds=1) and back[0]["event_count"] == 3


def test_smoothing(spark):
    y = [float(v) for v in np.random.default_rng(1).integers(0, 90, 60)]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(y)], "s INT, i INT, v DOUBLE")
    low = [r["smooth"] for r in smoothing.low_pass(df, "s", "v", ["i"]).orderBy("i").collect()]
    assert low[0] == y[0] and low[-1] == y[-1] and np.allclose(low[1:-1], [0.25 * a + 0.5 * b + 0.25 * c for a, b, c in zip(y, y[1:], y[2:])])
    sg = [r["smooth"] for r in smoothing.savgol(df, "s", "v", ["i"]).orderBy("i").collect()]
    assert sg[8] is None and sg[-9] is None
    fits = [max(0, np.polyval(np.polyfit(range(-9, 10), y[i - 9 : i + 10], 2), 0)) for i in range(9, 51)]
    assert np.allclose(sg[9:51], fits)
    for n in (60, 25, 12, 10, 9, 1):
        found = [r["smooth"] for r in smoothing.savgol_mirrored(df.filter(F.col("i") < n), "s", "v", ["i"]).orderBy("i").collect()]
        part = np.array(y[:n])
        if n > 9:
            ends = np.concatenate((part[0] - abs(part[9:0:-1] - part[0]), part, part[-1] + abs(part[-2:-11:-1] - part[-1])))
            part = [max(0, np.polyval(np.polyfit(range(-9, 10), ends[i : i + 19], 2), 0)) for i in range(n)]
        assert np.allclose(found, part), n
    with pytest.raises(ValueError):
        smoothing.savgol_weights(4, 2)
