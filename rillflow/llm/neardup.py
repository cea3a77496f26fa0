"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles (lower case; all its words where it has fewer):
count times inverse document frequency.  Frequencies are exact: each slice of texts sends its distinct
shingles, combined and packed by ranges of the hash, to be counted over all documents, and gets
their frequencies back; there is no table of them.  The weight is smoothed to lie between 1 and 2 so that
a large group of copies doesn't lose the weight of what it shares.

``BANDS * ROWS`` consistent samples make a signature: two texts agree in a sample with a probability of
their weighted Jaccard similarity.  Texts that agree in all samples of a band are candidates, and
weighted Jaccard on the whole texts decides.  At a similarity of 0.8 a pair misses all bands with a
probability of 2e-4.

A member's signature is compared with that of its bucket's smallest member, then those outside a
bucket's largest family with the bucket's members of other families; families are the components of
pairs whose signatures agree in at least ``AGREE`` samples.  So every pair that shares a band and can be
similar lies in one family.  A family of more than a block is first compared with one of its members,
the one that leads most of its buckets, exactly and text by text: those that link to it are one class
and need no comparison among themselves.  What is left of it is decided in pairs of blocks of about
``BLOCK`` texts; each pair of blocks decides all its pairs by matrix products and sends out only the
links that join them, fewer than its texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import send_package
from .common import _arrow_schema, cut, row_slices, texts_of, unused
from .graph import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Samples that must agree (in their low bytes) before texts are compared; at 0.8, 51 of 64 are expected.
AGREE = 32
PLANES = 8
#: Texts and total weight of a block at most (on average), and features of a slice of the matrices.
BLOCK, BLOCK_WEIGHT, FEATURES = 400, 400_000, 4096
#: Bits of a shingle's hash; n shingles meet another's hash in a share of n / 2**48, which only adds to its frequency.
HASH_BITS = 48
BUCKETS = 1 << 20
#: Shingles and texts of a slice at most (a text is never cut), bytes of text for a range of hashes, fewest ranges.
SLICE, SLICE_TEXTS, RANGE_BYTES, RANGES = 1 << 19, 1 << 16, 1 << 24, 64
NULL_ID = -(1 << 63)
_VARIATES = 1 << 14
_rng = np.random.default_rng(20240)
#: Gamma(2, 1), log Gamma(2, 1) and uniform variates of consistent sampling, picked by hash.
GAMMA_R = _rng.gamma(2, 1, _VARIATES).astype(np.float32)
LOG_C = np.log(_rng.gamma(2, 1, _VARIATES)).astype(np.float32)
BETA = _rng.random(_VARIATES).astype(np.float32)
INVERSE_R = (1 / GAMMA_R).astype(np.float32)
MULTIPLIERS = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles of a text and their counts."""
    words = text.lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(h))
    if size == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = (out ^ h[k : len(h) - size + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out >> np.uint64(64 - HASH_BITS), return_counts=True)


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(HASH_BITS - 20)).astype(np.int64)


def idf_of(frequencies: np.ndarray, documents: int) -> np.ndarray:
    ratio = documents / np.maximum(frequencies, 1)
    return (1 + np.log1p(ratio) / np.log1p(max(documents, 1))).astype(np.float32)


class Weights:
    """Shingle weights from a table of ``BUCKETS`` hashed frequencies: for a few texts only, as it fills up."""

    def __init__(self, frequencies: np.ndarray, documents: int):
        self.idf = idf_of(frequencies, documents)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        h, n = shingles(text)
        return h, n.astype(np.float32) * self.idf[bucket_of(h)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima; 0 where either set is empty."""
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return both / (total - both)


def signature(h: np.ndarray, w: np.ndarray, block: int = 2048) -> np.ndarray:
    """One 64-bit value a sample: a hash of the sampled shingle and its quantised weight."""
    best = np.full(SAMPLES, np.inf, np.float32)
    value = np.zeros(SAMPLES, np.uint64)
    lane = np.arange(SAMPLES)
    for at in range(0, len(h), block):
        part, log_w = h[at : at + block, None], np.log(w[at : at + block, None])
        i = ((part * MULTIPLIERS) >> np.uint64(50)).astype(np.int64)
        t = np.floor(log_w * INVERSE_R[i] + BETA[i])
        a = LOG_C[i] - GAMMA_R[i] * (t - BETA[i] + 1)
        k = a.argmin(axis=0)
        low = a[k, lane]
        better = low < best
        best = np.where(better, low, best)
        mixed = (part[k, 0] ^ (t[k, lane].astype(np.int64).astype(np.uint64) * _MIX2)) * _MIX
        value = np.where(better, mixed ^ (mixed >> np.uint64(32)), value)
    return value


def _packed(x: np.ndarray, plain: int = 0) -> bytes:
    """Length, then byte planes: the lowest ``plain`` ones (of random bytes) as they are, the others deflated."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return len(x).to_bytes(4, "little") + planes[:plain].tobytes() + zlib.compress(planes[plain:].tobytes(), 1)


def _unpacked(data: bytes, kind: str, plain: int = 0) -> np.ndarray:
    edge = 4 + plain * int.from_bytes(data[:4], "little")
    planes = np.frombuffer(data[4:edge] + zlib.decompress(data[edge:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed_hashes(h: np.ndarray) -> bytes:
    return _packed(np.diff(h, prepend=np.uint64(0)), 3)


def _unpacked_hashes(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, "<u8", 3), dtype=np.uint64)


#: Shingles of a slice in a range of hashes: their differences, and how many documents have each.  One row of a
#: slice has no shingles but its texts (digests, end to end) and which shingle stands how often in which text.
SLICED = "part int, slice long, hashes binary, frequencies binary, texts binary, sharers binary, owners binary, counts binary"


def _rows(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def _slices(whole: DataFrame, ranges: int) -> DataFrame:
    """The shingles of all texts, combined within slices of each task; a slice holds a text once, however often it stands."""
    send_package(whole.sparkSession)
    arrow = _arrow_schema(whole.sparkSession, SLICED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, made, held = TaskContext.get().partitionId(), 0, 0
        known: dict[bytes, int] = {}
        sets: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        times: list[int] = []

        def close() -> pa.RecordBatch:
            name = partition << 32 | made
            h = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(x) for x in sets])
            order = np.argsort(h, kind="stable")
            h, owner, n = h[order], owner[order], np.concatenate(counts)[order].astype(np.uint32)
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            frequency = np.add.reduceat(np.array(times, np.uint32)[owner], starts, dtype=np.uint32) if len(h) else np.zeros(0, np.uint32)
            sharers = np.diff(np.append(starts, len(h))).astype(np.uint32)
            out = [[(partition * 7919 + made) % ranges, name, None, None, b"".join(known), _packed(sharers), _packed(owner, 1), _packed(n)]]
            h = h[starts]
            part = (h >> np.uint64(HASH_BITS - 32)) * np.uint64(ranges) >> np.uint64(32)  # rises with the hash
            edges = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
            for p in np.flatnonzero(np.diff(edges)).tolist():
                at = slice(edges[p], edges[p + 1])
                out.append([p, name, _packed_hashes(h[at]), _packed(frequency[at]), None, None, None, None])
            known.clear(), sets.clear(), counts.clear(), times.clear()
            return _rows(arrow, list(zip(*out)))

        for batch in batches:
            for part in row_slices(batch, 512):
                for digest, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if digest not in known:
                        h, n = shingles(text)
                        known[digest] = len(sets)
                        sets.append(h), counts.append(n), times.append(0)
                        held += len(h)
                    times[known[digest]] += 1
                    if held >= SLICE or len(sets) == SLICE_TEXTS:
                        yield close()
                        made, held = made + 1, 0
        if sets:
            yield close()

    return whole.select("digest", "text").mapInArrow(run, SLICED)


def _counted(sliced: DataFrame) -> DataFrame:
    """The same rows with the frequencies over all slices; a range of hashes has at most one of a shingle a slice."""

    def count(group: pa.Table) -> pa.Table:
        at = [i for i, x in enumerate(group["hashes"].to_pylist()) if x is not None]
        if not at:
            return group
        hashes, found = group["hashes"].to_pylist(), group["frequencies"].to_pylist()
        parts = [_unpacked_hashes(hashes[i]) for i in at]
        here = np.concatenate([_unpacked(found[i], "<u4") for i in at])
        _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(inverse, weights=here).astype(np.uint32)[inverse]
        for i, x in zip(at, np.split(total, np.cumsum([len(x) for x in parts])[:-1])):
            found[i] = _packed(x)
        return group.set_column(group.schema.get_field_index("frequencies"), "frequencies", pa.array(found, pa.binary()))

    return sliced.groupBy("part").applyInArrow(count, SLICED)


SIGNED = "digest binary, total double, low array<long>, bands array<long>, frequencies binary"


def signatures(whole: DataFrame, documents: int, ranges: int = RANGES) -> DataFrame:
    """digest, total (weight), low (bytes of the samples), bands and frequencies of texts (digest, text); one row a text and slice.

    ``documents`` counts the rows of ``whole``, whose texts are not null.  ``frequencies``: documents that
    have each of the text's shingles, in the order of ``shingles``, packed as ``<u4``.
    """
    arrow = _arrow_schema(whole.sparkSession, SIGNED)

    def sign(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        columns = {k: group[k].to_pylist() for k in group.schema.names}
        own = next(i for i, x in enumerate(columns["texts"]) if x is not None)
        digests = [columns["texts"][own][i : i + 16] for i in range(0, len(columns["texts"][own]), 16)]
        at = [i for i, x in enumerate(columns["hashes"]) if x is not None]
        rows: list[tuple] = [(d, 0.0, [0] * PLANES, [], _packed(np.zeros(0, np.uint32))) for d in digests]
        if at:
            hashes = np.concatenate([_unpacked_hashes(columns["hashes"][i]) for i in at])
            found = np.concatenate([_unpacked(columns["frequencies"][i], "<u4") for i in at])
            which = np.repeat(np.arange(len(hashes), dtype=np.uint32), _unpacked(columns["sharers"][own], "<u4"))
            owner, n = _unpacked(columns["owners"][own], "<u2", 1), _unpacked(columns["counts"][own], "<u4")
            del columns
            order = np.argsort(owner, kind="stable")  # the hashes of a text keep their order
            which, n = which[order], n[order]
            edges = np.searchsorted(owner[order], np.arange(len(rows) + 1))
            for text, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                if b > a:
                    h, frequency = hashes[which[a:b]], found[which[a:b]]
                    w = n[a:b].astype(np.float32) * idf_of(frequency, documents)
                    rows[text] = digests[text], float(w.sum(dtype=np.float64)), *_sampled(signature(h, w)), _packed(frequency)
        return pa.Table.from_batches([_rows(arrow, list(zip(*rows)))])

    return _counted(_slices(whole, ranges)).groupBy("slice").applyInArrow(sign, SIGNED)


def _sampled(samples: np.ndarray) -> tuple[list[int], list[int]]:
    """The samples' low bytes as planes, and the keys of the bands."""
    bands = samples.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX2
    for r in range(ROWS):
        key = (key ^ bands[:, r]) * _MIX
        key ^= key >> np.uint64(31)
    return _planes(samples), key.view(np.int64).tolist()


def _planes(samples: np.ndarray) -> list[int]:
    """The samples' low bytes as eight bit planes of one bit a sample, as longs."""
    bits = ((samples[:, None] >> np.arange(PLANES, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(bits, axis=0).T).view(np.int64).ravel().tolist()


def _agreement(a: str, b: str):
    """Samples whose low bytes agree: those that differ in no bit plane."""
    differ = reduce(lambda x, y: x.bitwiseOR(y), (F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}")) for i in range(PLANES)))
    return SAMPLES - F.bit_count(differ)


def linked_rows(sets: list[tuple[np.ndarray, np.ndarray]], counts: list[np.ndarray], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Pairs of indices that join all sets linked by a weighted Jaccard similarity of ``threshold`` into trees.

    ``sets`` are (hashes, weights of one occurrence), ``counts`` the occurrences.  A shingle that stands n
    times is n features, so shared weight is a product of 0/1 matrices, taken over slices of features.
    """
    n = len(sets)
    totals = np.array([float((w * c).sum(dtype=np.float64)) for (_, w), c in zip(sets, counts)])
    owner = np.repeat(np.arange(n), [int(c.sum()) for c in counts])
    hashes = np.concatenate([np.repeat(h, c) for (h, _), c in zip(sets, counts)])
    rank = np.concatenate([np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) for c in counts]).astype(np.uint64)
    weight = np.concatenate([np.repeat(w, c) for (_, w), c in zip(sets, counts)])
    feature = hashes ^ (rank * _MIX2)
    _, column, many = np.unique(feature, return_inverse=True, return_counts=True)
    shared = many[column] > 1
    owner, column, weight = owner[shared], column[shared], weight[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column, weight = owner[order], column[order], weight[order]
    both = np.zeros((n, n))
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + FEATURES + 1, FEATURES))
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi > lo:
            base = column[lo]
            x = np.zeros((n, int(column[hi - 1] - base) + 1), np.float32)
            x[owner[lo:hi], column[lo:hi] - base] = np.sqrt(weight[lo:hi])
            both += x @ x.T
    rows, columns = np.nonzero(np.triu(both >= (threshold - 1e-5) * (totals[:, None] + totals[None, :] - both), 1))
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i, j in zip(rows.tolist(), columns.tolist()):
        if (u := root(i)) != (v := root(j)):
            exact = weighted_jaccard((sets[i][0], sets[i][1] * counts[i]), (sets[j][0], sets[j][1] * counts[j]))
            if exact >= threshold:
                parent[u] = v
                links.append((i, j))
    return links


def _sets_of(frequencies: bytes, text: str, documents: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(hashes, weights of one occurrence) and occurrences of a text's shingles."""
    h, n = shingles(text)
    return (h, idf_of(_unpacked(frequencies, "<u4"), documents)), n


def _star_links(placed: DataFrame, documents: int) -> DataFrame:
    """Links to the leader of each group of texts (group, salt, member, node, frequencies, text), read as a sorted stream.

    ``member`` is false for the leader, which stands first in every salt of its group.
    """
    send_package(placed.sparkSession)
    schema = "a long, b long"
    arrow = _arrow_schema(placed.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leader = None, None
        for batch in batches:
            links = []
            for part in row_slices(batch, 256):
                columns = [part.column(i).to_pylist() for i in range(6)]
                for group, salt, member, node, frequencies, text in zip(*columns):
                    (h, w), n = _sets_of(frequencies, text, documents)
                    if (group, salt) != now:
                        now, leader = (group, salt), (node, (h, w * n))
                    elif member and node != leader[0] and weighted_jaccard(leader[1], (h, w * n)) >= THRESHOLD:
                        links.append((node, leader[0]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], schema=arrow)

    dealt = placed.repartition("group", "salt").sortWithinPartitions("group", "salt", "member", "node")
    return dealt.select("group", "salt", "member", "node", "frequencies", "text").mapInArrow(run, schema)


def _block_links(placed: DataFrame, documents: int) -> DataFrame:
    """Links within each block of placed texts (group, low, high, node, frequencies, text), read as a sorted stream."""
    send_package(placed.sparkSession)
    schema = "a long, b long"
    arrow = _arrow_schema(placed.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sets: list[tuple[np.ndarray, np.ndarray]] = []
        counts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            links = linked_rows(sets, counts) if len(ids) > 1 else []
            out = pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in links], pa.int64()), pa.array([ids[j] for _, j in links], pa.int64())], schema=arrow)
            ids.clear(), sets.clear(), counts.clear()
            return out

        now = None
        for batch in batches:
            for part in row_slices(batch, 512):
                *keys, nodes, found, texts = (part.column(i).to_pylist() for i in range(6))
                for key, node, frequencies, text in zip(zip(*keys), nodes, found, texts):
                    if key != now:
                        yield close()
                        now = key
                    if ids and ids[-1] == node:
                        continue  # a repeated row
                    one, n = _sets_of(frequencies, text, documents)
                    if len(n):
                        ids.append(node), sets.append(one), counts.append(n)
        yield close()

    dealt = placed.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high", "node")
    return dealt.select("group", "low", "high", "node", "frequencies", "text").mapInArrow(run, schema)


def _families(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) of every text with company, and pairs (a, b) of members and leaders of buckets."""
    flat = distinct.select("node", *(F.get("low", F.lit(i)).alias(f"s{i}") for i in range(PLANES)))
    bands = distinct.select("node", F.explode("bands").alias("key"))
    keys = cut(bands.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = cut(bands.join(keys, "key").select("key", "node", "leader"))  # buckets with company only

    star = members.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    near = star.join(flat.alias("x"), F.col("a") == F.col("x.node")).join(flat.alias("y"), F.col("b") == F.col("y.node")).filter(_agreement("x", "y") >= AGREE).select("a", "b")
    near = cut(near)
    families = components(near)

    labelled = members.select("key", "node").join(families, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    labelled = cut(labelled)
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    sizes = labelled.join(open_keys, "key", "left_semi").groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = cut(sizes.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main")))
    rest = cut(labelled.join(largest, "key").join(flat, "node"))  # cut, so that the join can split a hot bucket
    x, y = rest.filter("component <> main").alias("x"), rest.alias("y")
    unlike = F.col("x.component") != F.col("y.component")
    # of two members outside the main family each meets the other: take such a pair once
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.node") > F.col("y.node"))
    wide = x.join(y, (F.col("x.key") == F.col("y.key")) & unlike & once & (_agreement("x", "y") >= AGREE)).select(F.col("x.component").alias("a"), F.col("y.component").alias("b")).distinct()
    joined = components(wide)
    mid = families.withColumnRenamed("component", "mid").join(joined.select(F.col("node").alias("mid"), "component"), "mid", "left").select("node", F.coalesce("component", "mid").alias("component"))
    return cut(mid.unionByName(joined.join(families.select("node"), "node", "left_anti"))), near


def _links(distinct: DataFrame, texts: DataFrame, documents: int) -> DataFrame:
    """Pairs (a, b) of nodes that join all similar texts of each family; ``texts``: exact_id, digest, text."""
    families, near = _families(distinct)
    told = distinct.select("node", "exact_id", "digest", "frequencies")

    def with_texts(rows: DataFrame) -> DataFrame:
        return rows.join(told, "node").join(texts, ["exact_id", "digest"])

    blocks = lambda: F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("total") / BLOCK_WEIGHT)).cast("int").alias("blocks")
    sized = cut(families.join(distinct.select("node", "total"), "node"))
    counts = cut(sized.groupBy("component").agg(blocks()))
    large = sized.join(counts.filter("blocks > 1"), "component")
    # the member of each large family that leads most of its pairs; a family without one has its smallest member
    support = near.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("led"))
    led = large.join(support, "node", "left").groupBy("component", "blocks").agg(F.max(F.struct(F.coalesce("led", F.lit(0)).alias("led"), (-F.col("node")).alias("down"), "node"))["node"].alias("leader"))
    leaders = cut(led)
    first = leaders.select(F.col("component").alias("group"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("leader").alias("node"))
    others = large.select(F.col("component").alias("group"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("salt"), F.lit(True).alias("member"), "node")
    star = cut(_star_links(with_texts(first.unionByName(others)), documents))
    main = star.select(F.col("a").alias("node")).unionByName(leaders.select(F.col("leader").alias("node"))).withColumn("rest", F.lit(0))

    # blocks of what links to the leader (numbered from 0) and of the rest (from ``mains``); a small family is one block of the rest
    sides = cut(sized.join(main, "node", "left").withColumn("rest", F.coalesce("rest", F.lit(1))))
    per_side = sides.groupBy("component", "rest").agg(blocks())
    shape = cut(per_side.groupBy("component").agg(F.coalesce(F.max(F.when(F.col("rest") == 0, F.col("blocks"))), F.lit(0)).alias("mains"), F.max(F.when(F.col("rest") == 1, F.col("blocks"))).alias("rests")).filter("rests is not null"))
    dealt = sides.join(shape, "component").withColumn("block", F.when(F.col("rest") == 0, F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("node"), F.col("rests"))).cast("int"))
    rest_blocks, main_blocks = F.sequence(F.col("mains"), F.col("mains") + F.col("rests") - 1), F.when(F.col("mains") > 0, F.sequence(F.lit(0), F.col("mains") - 1)).otherwise(F.array().cast("array<int>"))
    partner = F.when(F.col("rest") == 0, rest_blocks).otherwise(F.concat(main_blocks, rest_blocks))
    paired = dealt.withColumn("other", F.explode(partner))
    rows = paired.select(F.col("component").alias("group"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node")
    return star.unionByName(cut(_block_links(with_texts(rows), documents)))


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id (the smallest long for null), text and its digest (null for a null text)."""
    return texts_of(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text", F.unhex(F.md5("text")).alias("digest"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), exact_id (smallest doc_id with the same text), class_id (smallest doc_id of its component), component.

    Components join texts by chains of pairs with a weighted Jaccard similarity of at least 0.8.  One row a
    document: repeated rows (same doc_id and text) are one, different texts of one doc_id stay apart.
    A null text is a class of its own; a text without words only equals exact copies.  A null doc_id
    counts as the smallest long.  Texts are read whole, however long.  An empty table gives none.
    ``component`` names a class also where different texts of one doc_id make two classes' ``class_id`` equal.
    """
    named = _identified(docs)
    whole = named.filter("text is not null")
    size = whole.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    documents, ranges = size["n"], max(RANGES, (size["bytes"] or 0) // RANGE_BYTES)
    signed = cut(signatures(whole, documents, ranges))
    firsts = cut(whole.groupBy("digest").agg(F.min("doc_id").alias("exact_id")))  # cut, so that a join with it can split a hot text
    # texts that share their smallest doc_id (a null one, say) are told apart by a hash
    shared = firsts.groupBy("exact_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("exact_id", F.lit(True).alias("many"))
    nodes = cut(firsts.join(shared, "exact_id", "left").select("digest", "exact_id", F.when(F.col("many"), F.xxhash64("digest")).otherwise(F.col("exact_id")).alias("node")))
    distinct = cut(signed.dropDuplicates(["digest"]).join(nodes, "digest"))
    links = _links(distinct, whole.select(F.col("doc_id").alias("exact_id"), "digest", "text"), documents)

    placed = nodes.join(components(links), "node", "left").select("digest", "exact_id", F.coalesce("component", "node").alias("component"))
    class_ids = placed.groupBy("component").agg(F.min("exact_id").alias("class_id"))
    told = cut(placed.join(class_ids, "component").select("digest", "exact_id", "class_id", "component"))
    found = whole.select("doc_id", "digest").distinct().join(told, "digest").select("doc_id", "digest", "exact_id", "class_id", "component")
    alone = named.filter("text is null").select("doc_id").distinct()
    return found.unionByName(alone.select("doc_id", F.lit(None).cast("binary").alias("digest"), F.col("doc_id").alias("exact_id"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with its columns: of those with the smallest doc_id the one with the smallest digest.

    A null doc_id is the smallest.  Of repeated rows one stays.  Rows with a null text all stay.
    """
    found, names = classes(docs).filter("digest is not null"), unused(docs, "__id", "__leader")
    first = F.min(F.struct("doc_id", "digest")).alias("first")
    leaders = found.groupBy("component").agg(first).select(*(F.col(f"first.{c}").alias(n) for c, n in zip(("doc_id", "digest"), names)))
    keyed = docs.filter("text is not null").withColumns(dict(zip(names, (F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.unhex(F.md5(F.col("text").cast("string")))))))
    kept = keyed.dropDuplicates(names).join(leaders, names, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
    return kept.unionByName(docs.filter("text is null"))
