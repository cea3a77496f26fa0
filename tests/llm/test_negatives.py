import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.llm import negatives

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, score DOUBLE, block LONG, rank INT, vector STRING"


def brute(rows, every=50, positives=5, count=3, low=50, high=95):
    """All pairs, in whole numbers; rows are (vec_id, components or None, label)."""
    able = []
    for vec_id, x, label in rows:
        if label is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            able.append((negatives.NULL_ID if vec_id is None else vec_id, tuple(int(np.floor(256.0 * float(np.float32(c)))) for c in x), label))
    able, out = list(dict.fromkeys(able)), []
    clamp = lambda v: max(-(1 << 63), min(v, (1 << 63) - 1))
    long = lambda v: clamp(v)
    able = [(i, tuple(long(c) for c in v), y) for i, v, y in able]
    known = lambda i: None if i == negatives.NULL_ID else i
    for a in able:
        if a[0] == negatives.NULL_ID or a[0] % every:
            continue
        scored = sorted(((-clamp(sum(p * q for p, q in zip(a[1], b[1]))), b[0], b[2]) for b in able if b != a), key=lambda s: s[:2])
        for s, positive, _ in [r for r in scored if r[2] == a[2]][:positives]:
            window = [r for r in scored if r[2] != a[2] and low * -s <= 100 * -r[0] <= high * -s]
            out += [(known(a[0]), known(positive), k, known(n), -s, -t) for k, (t, n, _) in enumerate(window[:count], 1)]
    return sorted(out, key=repr)


def mined(spark, rows, every=50, **more):
    table = spark.createDataFrame([(i, x, y, 0.5, 3, 1, "v") for i, x, y in rows], SCHEMA)
    found = negatives.mine(negatives.whole_vectors(table), F.col("vec_id") % every == 0, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def clustered(n, width, labels, seed, noise=0.3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(7, width))
    return [(i, (centres[r.integers(7)] + noise * r.normal(size=width)).tolist(), int(r.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("width, noise, block, group, zones", [(3, 0.2, 16, 4, 3), (8, 0.5, 32, 7, 100), (64, 1.0, 64, 512, 2)])
def test_mining_is_the_brute_force_one(spark, monkeypatch, width, noise, block, group, zones):
    for name, value in (("BLOCK", block), ("GROUP", group), ("ZONES", zones)):
        monkeypatch.setattr(negatives, name, value)
    rows = clustered(400, width, 4, width, noise)
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 8)
    rows = clustered(60, 2, 2, 1)
    rows += [(0, None, 1), (1, [0.1, 0.2], None), (2, [float("nan"), 1.0], 1), (3, [None, 1.0], 1), (4, [float("inf"), 1.0], 1), (None, [3.0, 3.0], 1), (None, [2.0, 3.0], 0)]
    rows += [rows[10]] * 30 + [(100, [1.0], 0), (101, [], 1), (102, [1.0, 0.0, 0.0], 1), (10, [5.0, 5.0], 0)] + [(200 + i, [1.0, 1.0], i % 2) for i in range(40)]
    assert mined(spark, rows, 10) == brute(rows, 10)
    assert mined(spark, rows, 10, positives=2, negatives=7, low=10, high=100) == brute(rows, 10, 2, 7, 10, 100)
    assert mined(spark, rows, 1009) == brute(rows, 1009)
    assert mined(spark, [], 10) == mined(spark, [(1, [1.0], 1)], 10) == mined(spark, [(10, [1.0], 1)], 10) == []


def test_huge_components(spark):
    rows = [(i, [float(np.float32(random.Random(i).choice([1e3, -3e7, 4e12, 1e30, -1e38]))), float(i)], i % 3) for i in range(60)]
    assert mined(spark, rows, 5) == brute(rows, 5)


@pytest.mark.parametrize("width, bits", [(2, 1), (2, 3), (3, 2), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_the_grid(width, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=width)))
    places = [int("".join(map(str, row)), 2) for row in negatives.hilbert_bits(cells, bits).tolist()]
    assert sorted(places) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(places)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_bounds_hold_and_choose_few_blocks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(negatives, "BLOCK", 32)
    table = spark.createDataFrame([(i, x, y) for i, x, y in clustered(2000, 4, 3, 2, 0.05)], "vec_id LONG, embedding ARRAY<FLOAT>, label INT")
    rows = negatives.whole_vectors(table).withColumn("anchor", F.col("vec_id") % 50 == 0)
    shape = negatives.shape_of(rows)
    blocks = negatives.write_blocks(rows, shape, str(tmp_path / "blocks"))
    vectors = np.array([r.vector for r in rows.filter("anchor").collect()])
    held = blocks.collect()
    assert sum(b.n for b in held) == 2000 and all(b.n <= 32 for b in held)
    least, most = shape.bounds(vectors, np.array([b.low for b in held]), np.array([b.high for b in held]))
    for j, b in enumerate(held):
        scores = vectors @ shape.matrix(bytes(b.vectors), b.n).astype(int).T
        assert (least[:, j] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= most[:, j]).all()
    groups = negatives.anchor_groups(blocks, shape, 5)
    chosen = negatives.choose_blocks(negatives.first_windows(groups), blocks.select("block", "low", "high"), shape)
    asked = sum(r.m for r in chosen.select("m").collect())
    assert asked < 0.5 * len(vectors) * len(held)
