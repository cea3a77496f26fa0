"""Running values, halos, user aggregates, as-of joins, percentiles and residual ranks, with hot keys."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillflow.functions import smoothing
from rillflow.operators import asof, combine, filters, maps, scan
from rillflow.plans import iterate, metrics

T0 = dt.datetime(2024, 1, 1)


def series(seed, n=600, hot=0.9):
    """(key, time, id, value): most rows in one key, a third of those at one time, some null keys."""
    r = random.Random(seed)
    keys = [0 if r.random() < hot else r.choice([1, 2, None]) for _ in range(n)]
    return [(k, 50 if r.random() < 0.3 else r.randrange(200), i, r.randrange(10000) / 100) for i, k in enumerate(keys)]


@pytest.fixture(scope="module", params=[1 << 20, 60, 7])
def most(request):
    return request.param


@pytest.fixture(scope="module")
def hot(spark):
    return spark.createDataFrame(series(1), "k LONG, t LONG, id LONG, v DOUBLE").repartition(5).persist()


def in_order(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_parts_bound_the_rows_of_a_task(hot, most):
    parts = scan.in_parts(hot, "k", ["t", "id"], most)
    sizes = {(r["k"], r[scan.PART]): r["n"] for r in parts.groupBy("k", scan.PART).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(sizes.values()) == 600 and max(sizes.values()) <= max(most, 8)
    split = {k for k, part in sizes if part}
    assert split == {k for k in (0, 1, 2, None) if sum(n for (x, _), n in sizes.items() if x == k) > most}
    rows = sorted((r for r in parts.collect() if r["k"] == 0), key=lambda r: (r["t"], r["id"]))
    assert [r[scan.PART] for r in rows] == sorted(r[scan.PART] for r in rows)


def test_running_average_of_hot_keys(hot, most):
    found = in_order(maps.running_average(hot, "k", "v", ["t", "id"], most), "running_avg")
    for k in (0, 1, 2, None):
        cents, n = 0, 0
        for key, t, i, v in sorted((r for r in series(1) if r[0] == k), key=lambda r: (r[1], r[2])):
            cents, n = cents + round(v * 100), n + 1
            assert abs(found[i][0] - cents / 100 / n) < 1e-6


@pytest.mark.parametrize("smooth, reach", [("low_pass", 1), ("savgol", 9), ("savgol_mirrored", 9)])
def test_smoothing_of_hot_keys(hot, most, smooth, reach):
    whole = in_order(getattr(smoothing, smooth)(hot, "k", "v", ["t", "id"]), "smooth")
    found = in_order(getattr(smoothing, smooth)(hot, "k", "v", ["t", "id"], most=most), "smooth")
    assert len(found) == 600 and found.keys() == whole.keys()
    for i, (v,) in found.items():
        assert v == whole[i][0] or abs(v - whole[i][0]) < 1e-9
    halo = scan.with_halo(hot, "k", ["t", "id"], reach, most)
    sizes = halo.groupBy("k", scan.PART).count().agg(F.max("count")).first()[0]
    assert sizes <= max(most, 8) + 2 * reach


def test_scans_of_empty_tables(hot):
    none = hot.limit(0)
    assert maps.running_average(none, "k", "v", ["t"]).collect() == smoothing.low_pass(none, "k", "v", ["t"]).collect() == []


def collector(rows, last):
    held, out = {}, []
    for key, t, i, epoch, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in held:
            held[key] = (epoch, v)
        elif epoch > last or epoch < held[key][0]:
            continue
        elif epoch > held[key][0]:
            held[key] = (epoch, v)
        out.append((key, t, i, *held[key]))
    return sorted(out, key=repr)


def test_newest_epoch_has_four_cases(spark, most):
    rows = [(1, 1, 0, 3, 0.1), (1, 2, 0, 101, 0.2), (1, 3, 0, 3, 0.3), (1, 4, 0, 4, 0.4), (1, 5, 0, 2, 0.5), (1, 6, 0, 4, 0.6), (2, 1, 0, 200, 0.7), (2, 2, 0, 100, 0.8)]
    df = spark.createDataFrame(rows, "k LONG, t LONG, id LONG, epoch INT, v DOUBLE")
    found = sorted((tuple(r) for r in filters.newest_epoch(df, "k", "epoch", ["t", "id"], ["v"], 100, most).collect()), key=repr)
    assert found == [(1, 1, 0, 3, 0.1), (1, 3, 0, 3, 0.1), (1, 4, 0, 4, 0.4), (1, 6, 0, 4, 0.4), (2, 1, 0, 200, 0.7)] == collector(rows, 100)
    r = random.Random(3)
    many = [(k, t, i, r.randrange(1, 9), v) for k, t, i, v in series(2, 300) if k is not None]
    found = filters.newest_epoch(spark.createDataFrame(many, df.schema), "k", "epoch", ["t", "id"], ["v"], 6, most)
    assert sorted((tuple(x) for x in found.collect()), key=repr) == collector(many, 6)


def events(seed, n=500):
    r = random.Random(seed)
    times = [T0 + dt.timedelta(seconds=r.choice([r.randrange(90000), 5000 + r.randrange(40), 7200])) for _ in range(n)]
    return [(r.choice(["a", "b", None]), t, i, None if r.random() < 0.05 else r.randrange(50) / 2) for i, t in enumerate(times)]


@pytest.mark.parametrize("open_states", [combine.OPEN_STATES, 0])
def test_user_aggregates_by_brute_force(spark, open_states):
    rows = events(4)
    df = spark.createDataFrame(rows, "k STRING, ts TIMESTAMP_NTZ, id LONG, v DOUBLE").repartition(6)
    by_key = {k: [r for r in rows if r[0] == k] for k in ("a", "b", None)}

    def found(aggregate, keys=("k",)):
        states = combine.partial_states(df, list(keys), aggregate, open_states)
        return sorted((tuple(r) for r in combine.finished(combine.merged_states(states, list(keys), aggregate), list(keys), aggregate).collect()), key=repr)

    top, sessions, gaps = [], [], []
    for k, own in by_key.items():
        best = sorted((r for r in own if r[3] is not None), key=lambda r: (-r[3], r[2]))[:4]
        top += [(k, place, r[2], r[3]) for place, r in enumerate(best, 1)]
        times = sorted(r[1] for r in own)
        runs = [[times[0]]]
        for a, b in zip(times, times[1:]):
            runs.append([b]) if (b - a).total_seconds() > 60 else runs[-1].append(b)
        sessions += [(k, n, run[0], run[-1], len(run)) for n, run in enumerate(runs, 1)]
        gap, start = max(((b - a).total_seconds(), -(a - T0).total_seconds()) for a, b in zip(times, times[1:]))
        gaps += [(k, T0 + dt.timedelta(seconds=-start), gap)] if gap >= 500 else []
    assert found(combine.TopRows("v", "id", 4)) == sorted(top, key=repr)
    assert found(combine.Sessions("ts", 60)) == sorted(sessions, key=repr)
    assert gaps and found(combine.LongestGap("ts", 500)) == sorted(gaps, key=repr)
    assert found(combine.LongestGap("ts", 50_000)) == []
    assert len(found(combine.TopRows("v", "id", 3), ())) == 3


def test_user_aggregates_of_nothing(spark):
    none = spark.createDataFrame([], "k STRING, ts TIMESTAMP_NTZ, id LONG, v DOUBLE")
    for aggregate in (combine.TopRows("v", "id", 2), combine.Sessions("ts", 5), combine.LongestGap("ts", 5)):
        assert combine.combined(none, ["k"], aggregate).collect() == [] == combine.combined(none, [], aggregate).collect()


def test_a_hot_key_sends_one_state_a_task(spark):
    df = spark.range(20_000).selectExpr("0 AS k", "id", "CAST(id % 100 AS DOUBLE) AS v").repartition(5)
    states = combine.partial_states(df, ["k"], combine.TopRows("v", "id", 3))
    assert states.count() <= 5
    assert [tuple(r) for r in combine.combined(df, ["k"], combine.TopRows("v", "id", 3)).orderBy("place").collect()] == [(0, 1, 99, 99.0), (0, 2, 199, 99.0), (0, 3, 299, 99.0)]


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("cell", [10, 3600, 10**7])
def test_asof_by_brute_force(spark, forward, cell):
    r = random.Random(5)
    at = lambda: None if r.random() < 0.03 else T0 + dt.timedelta(seconds=r.choice([r.randrange(20000), 600]))
    key = lambda: r.choice([1, 1, 1, 2, 3, None])
    left, right = [(key(), at(), i) for i in range(200)], [(key(), at(), i, i * 1.5) for i in range(150)]
    l, rr = spark.createDataFrame(left, "k LONG, t TIMESTAMP_NTZ, l LONG").repartition(3), spark.createDataFrame(right, "k LONG, t TIMESTAMP_NTZ, id LONG, v DOUBLE").repartition(3)
    found = {x["l"]: x["found"] for x in asof.asof_join(l, rr, ["k"], "t", "id", cell, forward).collect()}
    assert len(found) == 200
    for k, t, i in left:
        able = [x for x in right if None not in (k, t, x[1]) and x[0] == k and (x[1] >= t if forward else x[1] <= t)]
        best = (min(able, key=lambda x: (x[1], x[2])) if forward else max(able, key=lambda x: (x[1], x[2]))) if able else None
        assert (found[i] and (found[i]["t"], found[i]["id"], found[i]["v"])) == (best and (best[1], best[2], best[3]))


def test_ticks_and_sampled_latency(spark):
    rows = [(1, T0 + dt.timedelta(milliseconds=m), i, v) for i, (m, v) in enumerate([(100, 5.0), (400, -1.0), (400, 9.0), (5000, 7.0), (7000, 3.0)])] + [(2, T0, 9, 1.0), (None, T0, 10, 1.0)]
    df = spark.createDataFrame(rows, "p LONG, t TIMESTAMP_NTZ, id LONG, latency_ms DOUBLE")
    found = metrics.sampled_latency(df, "p", "t", "id", 333, 5000, 1.0).collect()
    base, expected = (T0 - dt.datetime(1970, 1, 1)) // dt.timedelta(milliseconds=1), []
    for n in range(-(-(base + 100) // 333), (base + 2000) // 333 + 1):
        tick = T0 + dt.timedelta(milliseconds=n * 333 - base)
        after = min((r for r in rows[:5] if r[1] >= tick), key=lambda r: (r[1], r[2]))
        expected.append((1, tick, after[3] if after[3] > 0 else None))
    assert sorted(tuple(r) for r in found) == expected and len(expected) > 4


@pytest.mark.parametrize("name, values", [
    ("outlier", [1e18] + [float(i % 997) / 7 for i in range(3000)]), ("equal", [2.5] * 50), ("two", [1.0, 4.0]), ("one", [3.0]), ("skewed", (np.random.default_rng(1).pareto(0.3, 4000)).tolist()), ("nulls", [None, 1.0, 2.0, None, float(7)]),
])
@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_percentiles_are_exact(spark, name, values, accuracy):
    df = spark.createDataFrame([("g", v) for v in values] + [("none", None)], "k STRING, v DOUBLE").repartition(3)
    (row,) = metrics.summary(df, ["k"], "v", accuracy=accuracy).collect()
    own = pd.Series([v for v in values if v is not None])
    for p in (90, 95, 99):
        assert row[f"p{p}"] == pytest.approx(own.quantile(p / 100), rel=1e-9, abs=1e-6)
    assert (row["min"], row["max"]) == (own.min(), own.max())


def test_an_outlier_does_not_gather_values(spark):
    """Most of a group between its percentiles is only counted: few values are put in order."""
    values = spark.range(50_000).selectExpr("'g' AS k", "CASE WHEN id = 0 THEN 1e300 ELSE CAST(id * 7919 % 50000 AS DOUBLE) END AS v")
    found = metrics.summary(values, ["k"], "v")
    (row,) = found.collect()
    assert row["p90"] == pytest.approx(np.quantile([1e300] + [float(i * 7919 % 50000) for i in range(1, 50_000)], 0.9))


def test_residual_ranks_are_page_rank(spark):
    r = random.Random(7)
    pairs = list({(r.randrange(60), r.randrange(15)) for _ in range(300)} | {(i, i + 1) for i in range(60, 90)})
    edges = spark.createDataFrame(pairs, "from_id LONG, to_id LONG")
    sent = []
    found = {x["page_id"]: (x["rank"], x["epoch"]) for x in iterate.page_rank_by_residual(edges, 9, sent=sent).collect()}
    expected = {x["page_id"]: x["rank"] for x in iterate.page_rank(edges, 9).collect()}
    assert found.keys() == expected.keys() and all(abs(found[p][0] - expected[p]) < 1e-9 for p in found)
    assert sent[0] == len(found) and sent[-1] < sent[0] / 2 and sorted(sent, reverse=True) == sent
    loose = {x["page_id"]: x["rank"] for x in iterate.page_rank_by_residual(edges, 50, least=1e-2).collect()}
    exact = {x["page_id"]: x["rank"] for x in iterate.page_rank(edges, 50).collect()}
    assert max(abs(loose[p] - exact[p]) for p in exact) < 1e-2
    assert iterate.page_rank_by_residual(edges.limit(0), 3).collect() == []


@pytest.mark.parametrize("name", ["outlier", "pareto", "sorted", "equal", "few"])
def test_quantile_sketch_keeps_its_rank_error(spark, name):
    """Parts of any sizes, merged in any order, whatever the values."""
    r = np.random.default_rng(5)
    values = {"outlier": np.append(r.normal(size=60_000), 1e300), "pareto": r.pareto(0.2, 80_000), "sorted": np.arange(100_000.0), "equal": np.full(5000, 2.0), "few": r.normal(size=700)}[name]
    sketch = combine.Quantiles("v", tuple(range(1, 100)))
    states = [sketch.add(sketch.zero(), pd.DataFrame({"v": part})) for part in np.array_split(values, 37)]
    while len(states) > 1:
        a, b = (states.pop(r.integers(len(states))) for _ in range(2))
        states.append(sketch.merge(a, b))
    ordered = np.sort(values)
    for percent, value in sketch.finish(states[0]):
        low, high = np.searchsorted(ordered, value, "left") / len(values), np.searchsorted(ordered, value, "right") / len(values)
        off = max(low - percent / 100, percent / 100 - high, 0)
        assert off < (0.005 if len(values) > sketch.size else 1.5 / len(values)), (percent, off)
    assert sum(map(len, states[0][0])) <= sketch.size * max(1, np.log2(len(values) / sketch.size) + 2)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "v": values[:20_000]})).repartition(5)
    found = combine.combined(df, ["k"], combine.Quantiles("v", (50, 99))).collect()
    assert [x["percent"] for x in found] == [50, 99]
