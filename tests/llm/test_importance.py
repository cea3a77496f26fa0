import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rillflow.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, longest):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def brute(docs, target, longest, buckets, percent, least, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for text in texts for g in grams(text, longest)[0]) for texts in ([d[1] for d in docs], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text, *_ in docs:
        found, words = grams(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[2], r[1]))
    for place, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("longest, percent, least", [(1, 50, 3), (3, 100, 1), (2, 34, 20)])
def test_resample_is_the_brute_force_one(spark, make_docs, odd_rows, longest, percent, least, monkeypatch):
    monkeypatch.setattr(importance, "PIECE_BYTES", 50)
    monkeypatch.setattr(importance, "BATCH_GRAMS", 40)
    rows = [*odd_rows, (20, "Straße ÉTÉ été 3km/h x_y Z"), (21, "zz " * 30), (21, "zz " * 30), (22, "zz " * 30)]
    target = spark.createDataFrame([(1, "x zz Été", 4), (2, None, 5), (3, "W1 same line", 6)], "item_id LONG, text STRING, bucket INT")
    docs = make_docs(rows)
    gains = importance.learn_gains(docs, target, longest, 97)
    found = importance.resample(docs, gains, longest, percent, least, 7)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, ["x zz Été", None, "W1 same line"], longest, 97, percent, least, 7)


def test_words_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    text = "Aß1_b " * 400 + "x" * 300
    whole = [w for run in importance.word_runs(text) for w in run]
    monkeypatch.setattr(importance, "PIECE_BYTES", 17)
    assert [w for run in importance.word_runs(text) for w in run] == whole == [w.encode() for w in WORD.findall(text.translate(LOWER))]


@pytest.mark.parametrize("hashed", [None, lambda g: 5, lambda g: len(g), lambda g: (1 << 64) - 1 - g[0]])
def test_table_tells_grams_with_one_hash_apart(hashed):
    names = [f"g{i % 37}".encode() for i in range(500)]
    table = importance.GramTable(names, 11) if hashed is None else importance.GramTable(names, 11, hashed)
    assert [table.names[s] for s in table.slots] == names
    assert {table.names[s]: int(table.counts[s]) for s in np.flatnonzero(table.counts)} == Counter(names)
    expected = Counter(zlib.crc32(g) % 11 for g in names)
    assert table.bucket_counts(11).tolist() == [expected[b] for b in range(11)]


def test_empty_tables(spark, make_docs):
    empty = make_docs([])
    gains = importance.learn_gains(empty, empty.select("text"))
    assert gains == [0] * importance.BUCKETS and importance.resample(empty, gains).collect() == []


def test_numbering_of_many_equal_rows(spark):
    rows = [(5, 1)] * 40 + [(i, i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "a LONG, b LONG").repartition(7)
    found = importance.numbered(df, [df.b.desc(), df.a.asc()], "place").collect()
    assert [(r.a, r.b) for r in sorted(found, key=lambda r: r.place)] == sorted(rows, key=lambda r: (-r[1], r[0]))
    assert sorted(r.place for r in found) == list(range(1, 101))
