import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.plans import iterate, metrics, recovery

DAY = dt.datetime(2024, 1, 1)


def random_history(seed, sends, count=25):
    """(id, instance, time, dependencies) of ``count`` checkpoints; each has seen the last or the one before of those that send to it."""
    r, rows, taken = random.Random(str(seed)), [], {}
    for i in range(count):
        name = r.choice(sorted({x for pair in sends for x in pair}))
        seen = {a: taken[a][-1 - r.randrange(min(2, len(taken[a])))] for a, b in sends if b == name and taken.get(a)}
        rows.append((f"c{i}", name, DAY + dt.timedelta(seconds=i), seen))
        taken.setdefault(name, []).append(f"c{i}")
    return rows


def checkpoints_of(spark, rows):
    return spark.createDataFrame(rows, "id STRING, instance_name STRING, created_at TIMESTAMP, dependencies MAP<STRING,STRING>")


def brute_line(rows):
    """Pop any head that depends on a checkpoint at or after another head, predecessors' dependencies included."""
    stacks, at = {}, {}
    for i, name, _, needs in rows:
        stacks.setdefault(name, []).append(i)
        at[i] = (name, len(stacks[name]))
    needs = {r[0]: r[3] for r in rows}
    heads = {n: len(s) for n, s in stacks.items()}
    changed = True
    while changed:
        changed = False
        for n, h in heads.items():
            seen = [at[d] for i in stacks[n][:h] for d in needs[i].values()]
            if h and any(o != n and heads[o] and k >= heads[o] for o, k in seen):
                heads[n] -= 1
                changed = True
    return {n: stacks[n][h - 1] for n, h in heads.items() if h}


@pytest.mark.parametrize("sends", ["ab bc", "ab ac bd cd", "ab bc cb"])
def test_lines_match_brute_force(spark, sends):
    for seed in range(3):
        rows = random_history((seed, sends), sends.split())
        checkpoints = checkpoints_of(spark, rows)
        line = recovery.recovery_line(checkpoints)
        found = {r["instance_name"]: r["checkpoint_id"] for r in line.collect()}
        assert found == brute_line(rows)
        newer = {x["id"] for x in recovery.beyond_line(checkpoints, line).collect()}
        assert all((i in newer) == (int(i[1:]) > int(found[n][1:])) for i, n, *_ in rows if n in found)
        assert recovery.affected(line).count() == len(found)


def test_running_instances_stay_where_they_can(spark):
    """A reader of another's output goes back with it; one that sends only keeps its running state."""
    rows = random_history(7, ["ab", "bc"], 30)
    names = spark.createDataFrame([("b",)], "instance_name STRING")
    sends = spark.createDataFrame([("a", "b"), ("b", "c")], "from_name STRING, to_name STRING")
    found = {r["instance_name"]: r["checkpoint_id"] for r in recovery.recovery_line(checkpoints_of(spark, rows), names, sends).collect()}
    assert found["a"] == "" and found["b"] == [i for i, n, *_ in rows if n == "b"][-1] and found["c"] != ""


def random_edges(seed, n=40, m=70):
    r = random.Random(seed)
    return sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})


def test_hops_and_reach(spark):
    pairs = random_edges(1)
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "from_id LONG, to_id LONG, hops INT")
    best = {}
    for a in range(40):
        front, hops = {a}, 0
        while front and hops < 50:
            front, hops = {y for x, y in pairs if x in front}, hops + 1
            for b in front:
                best.setdefault((a, b), hops)
    for limit in (1, 2, 4):
        found = {(r["from_id"], r["to_id"]): r["hops"] for r in iterate.within_hops(edges, limit).collect()}
        assert found == {k: v for k, v in best.items() if v <= limit}
    assert {tuple(r) for r in iterate.reachable(edges).collect()} == set(best)


def test_page_rank(spark):
    pairs = random_edges(2)
    nodes = sorted({x for p in pairs for x in p})
    rank = {n: 1 / len(nodes) for n in nodes}
    for _ in range(6):
        out = {n: sum(1 for a, _ in pairs if a == n) for n in nodes}
        rank = {n: 0.15 / len(nodes) + 0.85 * sum(rank[a] / out[a] for a, b in pairs if b == n) for n in nodes}
    found = {r["page_id"]: r["rank"] for r in iterate.page_rank(spark.createDataFrame(pairs, "from_id LONG, to_id LONG"), 6).collect()}
    assert found.keys() == rank.keys() and all(abs(found[n] - rank[n]) < 1e-12 for n in nodes)
    with pytest.raises(ValueError):
        iterate.page_rank(spark.createDataFrame(pairs, "from_id LONG, to_id LONG"), 1, 1.5)


@pytest.mark.parametrize("n", [1, 2, 3, 20, 500])
def test_percentiles_are_exact(spark, n):
    r = random.Random(n)
    rows = [(g, float(v)) for g in ("a", "b") for v in ([r.choice([1, 1, 2, 5]) for _ in range(n)] if g == "a" else [r.gauss(0, 1) ** 3 for _ in range(n)])] + [("b", None), ("none", None)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    found = {x["g"]: x for x in metrics.summary(df, ["g"], "v").collect()}
    assert set(found) == {"a", "b"}
    for g in found:
        values = [v for k, v in rows if k == g and v is not None]
        for p in (90, 95, 99):
            assert abs(found[g][f"p{p}"] - np.percentile(values, p)) < 1e-5
        assert (found[g]["min"], found[g]["max"]) == (min(values), max(values))


def test_metric_logs(spark, tmp_path):
    (tmp_path / "log.txt").write_text("timestamp, forced, taken_ms, bytes\n00:00:01:500, True, 12, 2500\n timestamp, forced, taken_ms, bytes\n00:01:00:25, False, 8, 1400\n")
    log = metrics.read_log(spark, str(tmp_path / "log.txt"), metrics.CHECKPOINT_LOG).withColumns({"q": F.lit("q"), "run": F.lit(1)})
    assert sorted(r["millis"] for r in log.collect()) == [1500, 60250]
    r = metrics.checkpoint_summary(log, ["q"], "run").first()
    assert (r["total"], r["regular"], r["forced"], r["ms_mean"], r["kb_mean"]) == (2, 1, 1, 10, 2)
    starts = spark.createDataFrame([(1, 1000)], "run INT, start_millis LONG")
    assert sorted(r["millis"] for r in metrics.since_start(log, ["run"], starts).collect()) == [500, 59250]


def test_latency_is_null_unless_above_zero(spark):
    df = spark.createDataFrame([(DAY, DAY + dt.timedelta(milliseconds=5)), (DAY, DAY)], "event_time TIMESTAMP, output_time TIMESTAMP")
    assert [r["latency_ms"] for r in metrics.latency(df).collect()] == [5.0, None]
