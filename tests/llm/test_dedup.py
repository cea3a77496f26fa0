import hashlib
import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rillflow.llm import graph, neardup, substrings

from .conftest import prose


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def edited(seed, words, changes):
    out = prose(seed, words).split()
    for i, at in enumerate(changes):
        out[at] = f"new{seed}x{i}"
    return " ".join(out)


def near_rows():
    rows = [(i, prose(i, 120)) for i in range(1, 21)]
    rows += [(100 + k, edited(3, 120, [10 * k + 5])) for k in range(11)]  # one change each
    rows += [(200 + k, edited(4, 120, range(5, 5 + 6 * k, 6))) for k in range(8)]  # more and more changes
    return rows + [(300, prose(5, 120)), (301, prose(5, 120)), (302, "few words"), (303, "few words"), (304, "Few words here")]


def test_classes_are_those_of_all_pairs(make_docs):
    rows = near_rows()
    frequencies = np.zeros(neardup.BUCKETS, np.int64)
    for _, text in rows:
        frequencies[np.unique(neardup.bucket_of(neardup.shingles(text)[0]))] += 1
    weights = neardup.Weights(frequencies, len(rows))
    sets = {i: weights.of(t) for i, t in rows}
    texts = dict(rows)
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if texts[a] == texts[b] or neardup.weighted_jaccard(sets[a], sets[b]) >= 0.8]
    expected = union(links, sets)
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(make_docs(rows)).collect()}
    assert found == expected
    assert len({found[i] for i in range(1, 21) if i not in (3, 4, 5)}) == 17


def test_weights_are_those_of_exact_frequencies(make_docs, monkeypatch):
    monkeypatch.setattr(neardup, "SLICE", 500)  # several slices a task
    shared, words = prose(900, 30), prose(901, 5000).split()
    at: dict[int, list[str]] = {}
    for i in range(len(words) - 4):
        line = " ".join(words[i : i + 5])
        at.setdefault(int(neardup.bucket_of(neardup.shingles(line)[0])[0]), []).append(line)
    rare, common = next(lines for lines in at.values() if len(lines) > 1)[:2]  # one hashed counter of 2^20 for both
    rows = [(i, prose(i, 100) + " " + (shared if i % 2 else common)) for i in range(40)] + [(50, prose(1, 100) + " " + shared), (51, ""), (52, "one two"), (53, rare)]
    frequencies = Counter(h for _, text in rows for h in neardup.shingles(text)[0].tolist())
    digest = lambda t: hashlib.md5(t.encode()).digest()
    found = {bytes(r["digest"]): r for r in neardup.signatures(neardup._identified(make_docs(rows)), len(rows), 5).collect()}
    assert set(found) == {digest(t) for _, t in rows} and neardup._unpacked(found[digest(rare)]["frequencies"], "<u4").tolist() == [1]
    for _, text in rows:
        h, n = neardup.shingles(text)
        exact = np.array([frequencies[x] for x in h.tolist()], np.int64)
        w = n * (1 + np.log1p(len(rows) / exact) / np.log1p(len(rows)))
        assert neardup._unpacked(found[digest(text)]["frequencies"], "<u4").tolist() == exact.tolist()
        assert abs(found[digest(text)]["total"] - w.sum()) < 1e-3


def test_linked_rows_match_brute_force():
    r = np.random.default_rng(1)
    base = np.sort(r.choice(1 << 40, 300, replace=False)).astype(np.uint64)
    sets, counts = [], []
    for _ in range(60):
        h = np.sort(r.choice(base, r.integers(200, 300), replace=False))
        sets.append((h, (1 + (h % np.uint64(7)).astype(np.float32) / 7)))
        counts.append(r.integers(1, 4, len(h)))
    full = [(h, w * c) for (h, w), c in zip(sets, counts)]
    links = [(i, j) for i, j in itertools.combinations(range(60), 2) if neardup.weighted_jaccard(full[i], full[j]) >= 0.6]
    assert union(neardup.linked_rows(sets, counts, 0.6), range(60)) == union(links, range(60))
    assert 0 < len(links) < 60 * 59 / 2


def test_signatures_estimate_weighted_jaccard():
    a, b = edited(1, 400, range(0, 400, 40)), prose(1, 400)
    w = neardup.Weights(np.ones(neardup.BUCKETS), 1000)
    sa, sb = (neardup.signature(*w.of(t)) for t in (a, b))
    assert abs((sa == sb).mean() - neardup.weighted_jaccard(w.of(a), w.of(b))) < 0.2
    assert (neardup.signature(*w.of(prose(2, 400))) == sb).mean() < 0.1


def test_classes_of_odd_rows(make_docs, odd_rows, spark):
    found = {r["doc_id"]: r for r in neardup.classes(make_docs(odd_rows)).collect()}
    assert found[1]["class_id"] == 1 and found[6]["class_id"] == found[5]["class_id"] == 5
    assert found[2]["class_id"] == 2 and found[3]["class_id"] == 3 and neardup.NULL_ID in found
    assert len(found) == len({r[0] for r in odd_rows})
    assert neardup.classes(make_docs([])).collect() == []
    kept = neardup.keep_one(make_docs(odd_rows))
    assert kept.columns == make_docs([]).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11]


def test_large_families_are_decided_exactly(make_docs, monkeypatch):
    """A family of one star, and one that drifts away from its leader, so that the rest meets all blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rows = [(i, edited(77, 150, [i % 145])) for i in range(60)]
    rows += [(100 + i, edited(78, 150, range(3, 3 + 4 * i, 4))) for i in range(30)]
    texts = {i: neardup.shingles(t) for i, t in rows}
    frequencies = Counter(h for h, _ in texts.values() for h in h.tolist())
    sets = {i: (h, n * neardup.idf_of(np.array([frequencies[x] for x in h.tolist()]), len(rows))) for i, (h, n) in texts.items()}
    same = dict(rows)
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if same[a] == same[b] or neardup.weighted_jaccard(sets[a], sets[b]) >= 0.8]
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(make_docs(rows)).collect()} == union(links, sets)
    assert len({union(links, sets)[i] for i, _ in rows}) > 1


def test_texts_that_share_a_doc_id_stay_apart(make_docs):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, a), (1, b), (1, b), (2, b), (3, c), (None, a), (None, c + " more"), (4, None), (4, None)]
    found = sorted((r["doc_id"], r["exact_id"], r["class_id"]) for r in neardup.classes(make_docs(rows)).collect())
    low = neardup.NULL_ID
    assert found == sorted([(1, low, low), (low, low, low), (1, 1, 1), (2, 1, 1), (3, 3, low), (low, low, low), (4, 4, 4)])
    kept = sorted(((r["doc_id"], r["text"]) for r in neardup.keep_one(make_docs(rows)).collect()), key=repr)
    assert kept == sorted([(None, a), (1, b), (None, c + " more"), (4, None), (4, None)], key=repr)


def test_recall_against_all_pairs(spark):
    """Every pair of sf0.01 at 0.8 or more, found by an inverted index over all shingles, lies in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"] is not None}
    raw = {i: neardup.shingles(t) for i, t in texts.items()}
    frequencies = Counter(x for h, _ in raw.values() for x in h.tolist())
    sets = {i: (h, (n * neardup.idf_of(np.array([frequencies[x] for x in h.tolist()], np.int64), len(texts))).astype(np.float32)) for i, (h, n) in raw.items()}
    holders: dict[int, list[int]] = {}
    for i, (h, _) in raw.items():
        for x in h.tolist():
            if frequencies[x] > 1:
                holders.setdefault(x, []).append(i)
    pairs = {p for ids in holders.values() for p in itertools.combinations(ids, 2)}
    links = [p for p in pairs if neardup.weighted_jaccard(sets[p[0]], sets[p[1]]) >= 0.8]
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    met = sum(found[a] == found[b] for a, b in links)
    assert len(links) > 50 and met == len(links)
    expected = union([*links, *((a, b) for a, b in itertools.combinations(texts, 2) if texts[a] == texts[b])], texts)
    assert {i: found[i] for i in texts} == expected  # and no class joins what no chain of links joins


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200, i) for i in range(201, 230)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a LONG, b LONG")).collect()}
    assert found == union([p for p in pairs], {x for p in pairs for x in p})
    assert graph.components(spark.createDataFrame([], "a LONG, b LONG")).collect() == []


@pytest.mark.parametrize("edges_a_slice", (3, 16, graph.SLICE))
def test_components_in_slices(spark, monkeypatch, edges_a_slice):
    monkeypatch.setattr(graph, "SLICE", edges_a_slice)
    r = np.random.default_rng(3)
    pairs = [(int(a) - 60, int(b) - 60) for a, b in r.integers(0, 120, (70, 2))] + [(500 - i, 499 - i) for i in range(30)] + [(900, i) for i in range(880, 900)]
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    found = graph.components(spark.createDataFrame(pairs, "a LONG, b LONG").repartition(7)).collect()
    assert {r["node"]: r["component"] for r in found} == union(pairs, nodes)
    assert len(found) == len(nodes)


def test_components_of_few_edges_take_few_tasks(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a LONG, b LONG").repartition(50)
    context = spark.sparkContext
    context.setJobGroup("few-edges", "")
    try:
        assert {r["component"] for r in graph.components(edges).collect()} == {0}
        tracker = context.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup("few-edges") for s in tracker.getJobInfo(job).stageIds}
        assert sum(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)) < 200
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_chunks_cover_the_text_and_resist_shifts():
    text = prose(1, 3000) + " é😀" * 200
    chunks = substrings.chunks_of(text)
    assert "".join(text[s:e] for _, _, s, e in chunks) == text
    sizes = [len(text[s:e].encode()) for _, _, s, e in chunks]
    assert max(sizes) <= substrings.MAX_BYTES and min(sizes[:-1]) >= substrings.MIN_BYTES - 3
    moved = {c[:2] for c in substrings.chunks_of("zz " + text)}
    assert len(moved & {c[:2] for c in chunks}) > 0.97 * len(chunks)


def test_chunks_of_one_repeated_word_follow_it():
    """Without a place that qualifies, cuts follow the content too."""
    for word in ("Und ", "a", "straße "):
        one, two = ("x" * k + " " + word * (600 // len(word)) for k in (3, 50))
        a, b = ({c[:2] for c in substrings.chunks_of(t)} for t in (one, two))
        assert a & b, word


def test_gear_hash_is_the_rolling_one():
    data = np.frombuffer(prose(3, 50).encode(), np.uint8)
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(substrings.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    assert substrings.gear_hash(data).tolist() == out


def test_repeats(make_docs):
    passage = prose(50, 70)
    rows = [(i, prose(i, 100) + ("\n" + passage + "\n" if i in (3, 7, 9) else " ") + prose(1000 + i, 100)) for i in range(20)]
    rows += [(40, "All rights reserved by all. " + prose(40, 80)), (41, "All rights reserved by all. " + prose(41, 80))]
    found = {r["doc_id"]: r for r in substrings.repeats(make_docs(rows)).collect()}
    assert set(found) == {3, 7, 9}
    assert found[3]["n_removed"] == 0 and found[7]["first_doc_ids"] == [3] and found[9]["first_doc_ids"] == [3]
    for i in (3, 7, 9):
        (a, b), text = map(int, found[i]["spans"].split(":")), dict(rows)[i]
        assert passage in text[a:b] and b - a <= len(passage) + 8  # line feeds and first letters around it are shared too


def naive_chunks(text):
    """(start, end) of the chunks in code points, byte by byte."""
    data, h, ends, last_good, cuts, hashes = text.encode(), 0, [], None, [], {}
    for i, byte in enumerate(data):
        h = ((h << 1) + int(substrings.GEAR[byte])) & 0xFFFFFFFF
        border = i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80
        if border:
            hashes[i + 1] = h
        if h >> (32 - substrings.MASK_BITS) == 0 and border:
            if i + 1 - (last_good or 0) >= substrings.MIN_BYTES:
                cuts.append(i + 1)
            last_good = i + 1
    for end in [*cuts, *([len(data)] if data and (not cuts or cuts[-1] < len(data)) else [])]:
        while end - (ends[-1] if ends else 0) > substrings.MAX_BYTES:
            last = ends[-1] if ends else 0
            ends.append(min((h, -at) for at, h in hashes.items() if last + substrings.MIN_BYTES <= at <= last + substrings.MAX_BYTES)[1] * -1)
        ends.append(end)
    marks = [len(data[:e].decode()) for e in [0, *ends]]
    return list(zip(marks[:-1], marks[1:]))


def naive_repeats(rows, min_words):
    """Every column of the result from chunks as plain texts, all places in lists, and loops over characters."""
    low = -(1 << 63)
    texts = {(low if i is None else i, substrings_tid(t), t) for i, t, *_ in rows if t}
    by_key = {k[:2]: k[2] for k in texts}
    places: dict[str, list] = {}
    for key in texts:
        for a, b in naive_chunks(key[2]):
            places.setdefault(key[2][a:b], []).append((*key[:2], a))

    def alike(side, text, at, their, pos):
        k = 0
        if side == 0:
            while k < substrings.EDGE and at - k > 0 and pos - k > 0 and text[at - k - 1] == their[pos - k - 1]:
                k += 1
        else:
            while k < substrings.EDGE and at + k < len(text) and pos + k < len(their) and text[at + k] == their[pos + k]:
                k += 1
        return k

    def reach(side, own, text, a, b):
        """(what the chunk's side shares with any other place, what with the first place that has text there)"""
        at, shift = (a, 0) if side == 0 else (b, b - a)
        beside = sorted(p for p in places[text[a:b]] if (p[2] > 0 if side == 0 else p[2] + shift < len(by_key[p[:2]])))
        found = [(p, alike(side, text, at, by_key[p[:2]], p[2] + shift)) for p in beside if p != own]
        return max((k for _, k in found), default=0), next((k for p, k in found if p == beside[0]), 0)

    out = []
    for doc_id, tid, text in texts:
        runs = []
        for a, b in naive_chunks(text):
            held = sorted(places[text[a:b]])
            if len(held) > 1:
                chunk = (a, b, (doc_id, tid, a) != held[0], held[0])
                if runs and runs[-1][-1][1] == a:
                    runs[-1].append(chunk)
                else:
                    runs.append([chunk])
        spans, gone, n, n_gone, firsts = set(), set(), 0, 0, set()
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        inside = lambda a, b: sum(a <= x and y <= b for x, y in words)
        for run in runs:
            a, b = run[0][0], run[-1][1]
            before, first_before = reach(0, (doc_id, tid, a), text, *run[0][:2])
            after, first_after = reach(1, (doc_id, tid, run[-1][0]), text, *run[-1][:2])
            if inside(a - before, b + after) < min_words:
                continue
            spans |= set(range(a - before, b + after))
            n += len(run)
            firsts |= {c[3][0] for c in run if c[2]}
            for later, part in itertools.groupby(run, key=lambda c: c[2]):
                part = list(part)
                x, y = a - first_before if part[0][0] == a else part[0][0], b + first_after if part[-1][1] == b else part[-1][1]
                if later and inside(x, y) >= min_words:
                    gone |= set(range(x, y))
                    n_gone += len(part)
        if spans:
            ranges = lambda s: ",".join(f"{x}:{y + 1}" for x, y in zip(sorted(i for i in s if i - 1 not in s), sorted(i for i in s if i + 1 not in s)))
            out.append((doc_id, n, len(spans), n_gone, len(gone), ranges(spans), ranges(gone), tuple(sorted(firsts - {doc_id}))))
    return sorted(out)


def substrings_tid(text):
    """Order of texts that share a doc_id: any, but the same as the operator's."""
    return TIDS[text]


TIDS: dict[str, int] = {}


@pytest.mark.parametrize("neighbours", [None, 4])
def test_repeats_match_brute_force(spark, make_docs, odd_rows, monkeypatch, neighbours):
    from pyspark.sql import functions as F

    shared = [prose(900 + k, 60) for k in range(4)]
    rows = odd_rows + [(i, prose(i % 3, 90)) for i in range(20, 26)]
    rows += [(30 + i, f"{prose(i + 60, 30)} {shared[i % 4]}é {shared[(i * 3) % 4][:200]}\n{prose(i + 90, 30)}") for i in range(16)]
    rows += [(50, shared[0] + " tail " + prose(200, 50)), (50, "head " + prose(201, 50) + shared[0]), (None, shared[1] + " x"), (None, "y " + shared[1])]
    rows += [(60 + i, f"{prose(i + 300, 20)} {' '.join(shared[2].split()[: 50 - 4 * (i % 4)])} {prose(i + 320, 20)}") for i in range(9)]
    docs = make_docs(rows)
    TIDS.update({r["text"]: r["tid"] for r in docs.filter("text IS NOT NULL").select("text", F.xxhash64("text").alias("tid")).collect()})
    if neighbours:
        monkeypatch.setattr(substrings, "NEIGHBOURS", neighbours)
    for least in (substrings.MIN_WORDS, 12):
        found = sorted((*tuple(r)[:-1], tuple(r["first_doc_ids"])) for r in substrings.repeats(docs, least).collect())
        assert found == naive_repeats(rows, least)
    assert substrings.repeats(make_docs([])).collect() == []


def test_passages_of_51_words_are_found(make_docs):
    """Passages between unlike contexts: a run holds one whole chunk of each at least."""
    rows = []
    for k in range(150):
        passage = prose(5000 + k, 51, "ab")
        rows += [(2 * k + j, f"{prose(k * 7 + j, 20)} {passage} {prose(k * 11 + j, 20, 'q')}") for j in (0, 1)]
    found = {r["doc_id"]: r["spans"] for r in substrings.repeats(make_docs(rows)).collect()}
    assert len(found) >= 0.99 * len(rows)
    texts = dict(rows)
    for i, spans in found.items():
        a, b = map(int, spans.split(",")[0].split(":"))
        assert prose(5000 + i // 2, 51, "ab") in texts[i][a:b]


def test_keep_one_keeps_columns_of_any_name(spark):
    rows = [(1, prose(1, 40), 7, "x"), (2, prose(1, 40), 8, "y"), (3, prose(2, 40), 9, "z"), (4, None, 10, "n")]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id LONG, text STRING, __id LONG, __LEADER STRING"))
    assert kept.columns == ["doc_id", "text", "__id", "__LEADER"]
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2], rows[3]]


@pytest.mark.parametrize("own, shared", [(42, 38), (44, 30)])
def test_passages_reach_as_far_as_any_other_place(make_docs, own, shared):
    """Two documents share a passage of which a third shares the beginning (or the end): all of it is found."""
    rows, passages = [], {}
    for k in range(150):
        passage, ends = prose(50_000 + k, own, "p").split(), [prose(60_000 + 10 * k + j, 25, "q") for j in range(6)]
        part = passage[:shared] if k % 2 else passage[-shared:]
        for j, words in enumerate((passage, passage, part)):
            rows.append((3 * k + (j + k) % 3, f"{ends[j]} {' '.join(words)} {ends[j + 3]}"))
            passages.setdefault(" ".join(passage), []).append(3 * k + (j + k) % 3) if j < 2 else None
    texts = dict(rows)
    found = {r["doc_id"]: r["spans"] for r in substrings.repeats(make_docs(rows)).collect()}
    for passage, ids in passages.items():
        for i in ids:
            at = texts[i].index(passage)
            assert any(a <= at and at + len(passage) <= b for a, b in (map(int, s.split(":")) for s in found.get(i, "").split(",") if s)), (i, found.get(i))


def test_repeats_leave_no_intermediate_tables(spark, make_docs):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")

    def size():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)

    shared, before = prose(77, 60), size()
    docs = make_docs([(i, f"{prose(1000 + i, 30)} {shared} {prose(2000 + i, 30)}") for i in range(200)])
    found = substrings.repeats(docs)
    assert size() - before < 200_000  # of checkpoints; the texts beside chunks alone have about that many characters
    assert found.count() == 200


def naive_ends(rows):
    """What ``_shared_ends`` gives for rows (group, place, single, solid, text) of whole groups: by comparing all pairs."""
    out = []
    for group, place, single, solid, text in rows:
        others = [r for r in rows if r[0] == group]
        alike = lambda a, b: min(len(os.path.commonprefix((a, b))), substrings.EDGE)
        n = max((alike(text, r[4]) for r in others if single == 0 or r[1] != place), default=0)
        first = min(others, key=lambda r: r[1])
        side, found = group[2], []
        for k in (n, alike(text, first[4]), 0):
            shown = (text[::-1], len(text)) if side == 0 else (("x" if solid else " ") + text, 1)
            a, b = (shown[1] - k, shown[1]) if side == 0 else (1, 1 + k)
            starts = [m.start() for m in re.finditer(r"\S+", shown[0])]
            over = side == 1 and b < len(shown[0]) and not shown[0][b - 1].isspace() and not shown[0][b].isspace()
            found += [k, sum(a <= x < b for x in starts), int(over)]
        out.append((*group[:3], text.encode(), *first[1], *found[:6], found[8]))
    return out


@pytest.mark.parametrize("decoded, batch", [(20_000, 7), (0, 7), (20_000, 5000), (0, 1)])
def test_longest_matches_of_whole_groups(monkeypatch, decoded, batch):
    """Neighbours in order give the longest match and what is shared with the first place, over batches and stretches of any size."""
    r = random.Random(5)
    monkeypatch.setattr(substrings, "DECODED", decoded)
    stretches = substrings._stretches
    monkeypatch.setattr(substrings, "_stretches", lambda table: stretches(table, 5))
    groups = [(h, lo, side) for h in range(-3, 3) for lo in (1, 2) for side in (0, 1)]
    rows = []
    for group in groups:
        solid, texts = r.random() < 0.5, set()
        for _ in range(r.choice((1, 2, 9, 40))):
            texts.add("".join(r.choice("ab é\u3000😀\x85") for _ in range(r.choice((1, 3, 8)))) * r.choice((1, 1, 90)))
        texts = sorted({t[: substrings.EDGE + 1] for t in texts}, key=str.encode)
        rows += [(group, (r.randrange(4), r.randrange(3), i), r.random() < 0.7, solid, t) for i, t in enumerate(texts)]
    columns = {"hi": [g[0] for g, *_ in rows], "lo": [g[1] for g, *_ in rows], "side": [g[2] for g, *_ in rows], "__part": [0] * len(rows), "__own": [True] * len(rows)}
    columns |= {"solid": [x[3] for x in rows], "single": [x[2] for x in rows], "first_beside": [None] * len(rows), "beside": [x[4] for x in rows], "key": [x[4].encode() for x in rows]}
    columns |= {f"first_{c}": [x[1][k] for x in rows] for k, c in enumerate(substrings.PLACE)}
    batches = pa.table(columns).to_batches(max_chunksize=batch)
    found = []
    for whole in substrings._whole_groups(iter(batches), ["hi", "lo", "side", "__part"]):
        found += zip(*(c.tolist() if hasattr(c, "tolist") else c.to_pylist() for c in substrings._shared_ends(whole)))
    assert found == naive_ends(rows)


def test_python_work_of_repeats_goes_by_slices(make_docs, monkeypatch):
    """Past a digest for each chunk and a slice of text for each edge, no Python call is made for a chunk, a run, a match or an end."""
    import sys

    from pyspark.sql.classic.dataframe import DataFrame

    calls, mapped = [], DataFrame.mapInArrow

    def counted(self, fn, *args, **kwargs):
        def called(frame, event, what):
            calls.append(1) if event == "call" or event == "c_call" and what.__name__ != "xxh3_128_digest" else None

        batches = self.toArrow().to_batches()
        sys.setprofile(called)
        try:
            list(fn(iter(batches)))
        finally:
            sys.setprofile(None)
        return mapped(self, fn, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "mapInArrow", counted)
    made = []
    for n in (20, 120):
        passages, before = [prose(7000 + k, 60) for k in range(4)], len(calls)
        rows = [(i, " ".join(f"{prose(100 * i + k, 20)} {passages[(i + k) % 4]}" for k in range(4))) for i in range(n)]
        assert substrings.repeats(make_docs(rows)).count() == n
        made.append(len(calls) - before)
    assert (made[1] - made[0]) / 100 < 60, made  # a text here has about 70 chunks and 8 edges
