"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Whole-number vectors are put in the order of a Hilbert curve through all dimensions and cut into blocks,
written as Parquet: a block is one row with its vectors and, in columns of their own, the least and
largest value of each dimension (its zone map).  For an anchor, interval arithmetic over a zone map gives
the least and largest score that any row of the block can have; both are matrix products for all anchors
of a group and all zone maps of a chunk.  Only blocks whose bounds reach an anchor's window are read
for it, first for its positives, then for the negatives of each positive.

What a window must reach rises with what is known: the anchor's own block, at hand when anchors are
gathered, gives a first bound for its positives and a list of its best scores of other labels.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import send_package
from .common import checkpoint_dir, cut, delete_folder, map_columns

#: Rows of a block, anchors of a group, zone maps that are compared at once, scores kept from an anchor's own block.
BLOCK, GROUP, ZONES, NEAR = 1024, 512, 256, 32
#: Bits a dimension of the curve, and bytes of its index that the order uses.
BITS, KEY_BYTES = 2, 16
NULL_ID = -(1 << 63)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_vectors(embeddings: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label, vector (floor of ``scale`` times each component) of the rows that take part.

    Rows with a null label or vector, or a component that is null or not finite, take no part.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    able = rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", odd))
    return able.select("vec_id", "label", F.transform("vector", lambda x: F.floor(scale * x)).alias("vector"))


@dataclass(frozen=True)
class Shape:
    """Dimensions, largest absolute component, and the quartiles of the components."""

    width: int
    top: int
    quartiles: tuple[int, ...]

    @property
    def stored(self) -> np.dtype:
        return np.dtype(next((t for t in ("<i2", "<i4") if self.top < 2 ** (8 * np.dtype(t).itemsize - 1)), "<i8"))

    @property
    def small(self) -> bool:
        """Whether doubles hold every score, and longs a score with its place in a block."""
        return self.width * self.top**2 < 1 << 50

    def matrix(self, data: bytes, rows: int) -> np.ndarray:
        return np.frombuffer(data, self.stored).reshape(rows, self.width)

    def product(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a @ b as exact whole numbers; those beyond longs count as the least or largest long."""
        if self.small:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
        return np.clip(a.astype(object) @ b.astype(object), -(1 << 63), (1 << 63) - 1) if self.width else np.zeros((len(a), b.shape[1]), object)

    def bounds(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest score of each anchor over each zone map."""
        wide = anchors.astype(np.int64)
        sides, ends = np.hstack([np.maximum(wide, 0), np.minimum(wide, 0)]), (np.hstack([low, high]), np.hstack([high, low]))
        least, most = (self.product(sides, end.T) for end in ends)
        return least, most


def shape_of(rows: DataFrame) -> Shape | None:
    """From one pass; the quartiles of one component a row, chosen by its id.  None for an empty table."""
    one = F.try_element_at("vector", (F.pmod(F.xxhash64("vec_id"), F.greatest(F.size("vector"), F.lit(1))) + 1).cast("int"))
    most = F.greatest(F.abs(F.array_max("vector").cast("decimal(20,0)")), F.abs(F.array_min("vector").cast("decimal(20,0)")))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"), F.max(most).alias("top"), F.percentile_approx(one, [0.25, 0.5, 0.75], 1000).alias("cuts")).first()
    return Shape(found["width"], int(found["top"] or 0), tuple(found["cuts"] or (0, 0, 0))) if found["n"] else None


def hilbert_bits(cells: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each row's place on the Hilbert curve through a grid of 2**bits cells a dimension, highest first."""
    x = cells.astype(np.uint8).T.copy()
    for level in range(bits - 1, 0, -1):  # undo the turns of the cubes within cubes
        below = np.uint8((1 << level) - 1)
        for i in range(len(x)):
            inverted = (x[i] >> level) & 1 == 1
            swapped = np.where(inverted, 0, (x[0] ^ x[i]) & below).astype(np.uint8)
            x[0] ^= np.where(inverted, below, swapped)
            x[i] ^= swapped
    x = np.bitwise_xor.accumulate(x, axis=0)
    turn = np.zeros(x.shape[1], np.uint8)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, np.uint8((1 << level) - 1), np.uint8(0))
    x ^= turn
    return np.concatenate([(x >> level) & 1 for level in range(bits - 1, -1, -1)]).T


def hilbert_keys(vectors: np.ndarray, quartiles: tuple[int, ...]) -> list[bytes]:
    """The first bytes of each vector's place on the curve, over cells between the quartiles."""
    if not vectors.shape[1]:
        return [b""] * len(vectors)
    packed = np.packbits(hilbert_bits(np.searchsorted(np.array(quartiles), vectors, side="right"), BITS), axis=1)[:, :KEY_BYTES]
    return [row.tobytes() for row in packed]


def write_blocks(rows: DataFrame, shape: Shape, folder: str) -> DataFrame:
    """block, n, ids, labels, anchors, vectors (all packed), low, high (the zone map): rows in the curve's order.

    Ranges of the order are dealt by sampled bounds; equal vectors are told apart by their ids, so that no
    range is larger for them.
    """
    stored = shape.stored

    def keyed(columns: dict[str, list]) -> dict[str, list]:
        vectors = np.zeros((len(columns["vector"]), shape.width), np.int64)
        for i, v in enumerate(columns["vector"]):
            vectors[i, : len(v)] = v
        packed = [v.tobytes() for v in vectors.astype(stored)]
        return {"key": hilbert_keys(vectors, shape.quartiles), "vec_id": columns["vec_id"], "label": columns["label"], "anchor": columns["anchor"], "vector": packed}

    def block(number: int, rows: pa.Table) -> dict[str, list]:
        data = b"".join(rows.column("vector").to_pylist())
        vectors = shape.matrix(data, rows.num_rows).astype(np.int64)
        pack = lambda name, kind: rows.column(name).to_numpy().astype(kind).tobytes()
        zone = (vectors.min(axis=0).tolist(), vectors.max(axis=0).tolist())
        return {"block": [number], "n": [rows.num_rows], "ids": [pack("vec_id", "<i8")], "labels": [pack("label", "<i8")], "anchors": [pack("anchor", "<u1")], "vectors": [data], "low": [zone[0]], "high": [zone[1]]}

    schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "anchors", "vectors")), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            while held.num_rows >= BLOCK:
                yield pa.RecordBatch.from_pydict(block(number, held.slice(0, BLOCK)), schema)
                number, held = number + 1, held.slice(BLOCK)
        if held is not None and held.num_rows:
            yield pa.RecordBatch.from_pydict(block(number, held), schema)

    placed = map_columns(rows, keyed, "key binary, vec_id long, label long, anchor boolean, vector binary")
    order = ["key", "vec_id", "label", "vector"]
    sorted_ = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    ddl = "block long, n int, ids binary, labels binary, anchors binary, vectors binary, low array<long>, high array<long>"
    sorted_.mapInArrow(blocks, ddl).write.parquet(folder)
    return rows.sparkSession.read.schema(ddl).parquet(folder)


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _itself(ids: np.ndarray, vectors: np.ndarray, other_ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a row stands on either side."""
    a, b = np.nonzero(ids[:, None] == other_ids[None])
    same = (vectors[a] == others[b]).all(axis=1)
    return a[same], b[same]


def anchor_groups(blocks: DataFrame, shape: Shape, positives: int) -> DataFrame:
    """grp, n, ids, labels, vectors, floors, near: anchors in groups of at most ``GROUP``.

    ``floors``: a score that at least ``positives`` rows of an anchor's block and label reach (the least
    long where there are fewer); ``near``: the ``NEAR`` best scores of other labels in the block.
    """
    least = np.iinfo(np.int64).min

    def of_block(ids: np.ndarray, labels: np.ndarray, chosen: np.ndarray, vectors: np.ndarray) -> tuple:
        at = np.flatnonzero(chosen)
        scores = shape.product(vectors[at], vectors.T)
        scores = np.where(scores == least, least + 1, scores)
        own = labels[at][:, None] == labels[None]
        own_scores = np.where(own, scores, least)
        own_scores[_itself(ids[at], vectors[at], ids, vectors)] = least
        best = np.sort(own_scores, axis=1)
        floors = best[:, -positives] if best.shape[1] >= positives else np.full(len(at), least)
        near = np.sort(np.where(own, least, scores), axis=1)[:, -NEAR:]
        near = np.hstack([np.full((len(at), NEAR - near.shape[1]), least), near])
        floors, near = (np.where(x == least + 1, least, x).astype(np.int64) for x in (floors, near))
        return ids[at], labels[at], vectors[at], floors, near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count = TaskContext.get().partitionId() << 32, [], 0

        def group() -> pa.RecordBatch:
            ids, labels, vectors, floors, near = (np.concatenate(parts) for parts in zip(*held))
            packed = (ids.astype("<i8"), labels.astype("<i8"), vectors.astype(shape.stored), floors.astype("<i8"), near.astype("<i8"))
            return pa.RecordBatch.from_pydict({"grp": pa.array([number]), "n": pa.array([len(ids)], pa.int32())} | {name: pa.array([a.tobytes()]) for name, a in zip(("ids", "labels", "vectors", "floors", "near"), packed)})

        for batch in batches:
            for i in range(batch.num_rows):
                n, *data = (batch.column(c)[i].as_py() for c in ("n", "ids", "labels", "anchors", "vectors"))
                chosen = np.frombuffer(data[2], "u1").astype(bool)
                more = int(chosen.sum())
                if not more:
                    continue
                if count and count + more > GROUP:
                    yield group()
                    number, held, count = number + 1, [], 0
                ids, labels, vectors = _ints(data[0]), _ints(data[1]), shape.matrix(data[3], n)
                for first in range(0, more, GROUP):
                    part = np.zeros(n, bool)
                    part[np.flatnonzero(chosen)[first : first + GROUP]] = True
                    if count and count + part.sum() > GROUP:
                        yield group()
                        number, held, count = number + 1, [], 0
                    held.append(of_block(ids, labels, part, vectors))
                    count += int(part.sum())
        if count:
            yield group()

    return cut(blocks.select("n", "ids", "labels", "anchors", "vectors").mapInArrow(run, "grp long, n int, ids binary, labels binary, vectors binary, floors binary, near binary"))


def choose_blocks(groups: DataFrame, zones: DataFrame, shape: Shape) -> DataFrame:
    """block, grp, m, who, labels, ids, vectors, windows, floors, ceilings: for each block the windows of a group that its bounds reach.

    ``groups`` has grp, n, ids, labels, vectors and windows, an array of (who, window, floor, ceiling).  Zone maps
    are compared in chunks of about ``ZONES``; a group meets each chunk once.
    """
    chunks = max(1, -(-zones.count() // ZONES))
    chunked = zones.groupBy(F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int").alias("chunk")).agg(F.collect_list(F.struct("block", "low", "high")).alias("zones"))
    met = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(chunked, "chunk")
    names = ("block", "grp", "m", "who", "ids", "labels", "vectors", "whose", "windows", "floors", "ceilings")

    def work(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in names}
        for grp, n, ids, labels, data, windows, found in zip(*(columns[c] for c in ("grp", "n", "ids", "labels", "vectors", "windows", "zones"))):
            ids, labels, vectors = _ints(ids), _ints(labels), shape.matrix(data, n)
            who, window, floor, ceiling = (np.array([w[c] for w in windows], np.int64) for c in ("who", "window", "floor", "ceiling"))
            low, high = (np.array([z[side] for z in found], np.int64).reshape(-1, shape.width) for side in ("low", "high"))
            least, most = shape.bounds(vectors, low, high)
            reached = (most[who] >= floor[:, None]) & (least[who] <= ceiling[:, None])
            for j, zone in enumerate(found):
                at = np.flatnonzero(reached[:, j].astype(bool))
                if not len(at):
                    continue
                asked, whose = np.unique(who[at], return_inverse=True)
                pack = lambda a, kind="<i8": a.astype(kind).tobytes()
                row = (zone["block"], grp, len(asked), pack(asked), pack(ids[asked]), pack(labels[asked]), pack(vectors[asked], shape.stored), pack(whose), pack(window[at]), pack(floor[at]), pack(ceiling[at]))
                for k, v in zip(names, row):
                    out[k].append(v)
        return out

    schema = "block long, grp long, m int, " + ", ".join(f"{c} binary" for c in names[3:])
    return map_columns(met.select("grp", "n", "ids", "labels", "vectors", "windows", "zones"), work, schema, 4)


def best_in_windows(chosen: DataFrame, blocks: DataFrame, shape: Shape, most: int, same_label: bool) -> DataFrame:
    """grp, who, window, score, vec_id: of each window the ``most`` best rows over all chosen blocks, ties to the smaller id.

    Only rows of the anchor's label count, without itself, or only those of other labels.
    """

    def work(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("grp", "who", "window", "score", "vec_id")}
        for row in zip(*columns.values()):
            r = dict(zip(columns, row))
            their_ids, their_labels = _ints(r["their_ids"]), _ints(r["their_labels"])
            order = np.argsort(~their_ids, kind="stable")  # small ids last
            their_ids, their_labels, theirs = their_ids[order], their_labels[order], shape.matrix(r["their_vectors"], r["n"])[order]
            who, ids, labels, vectors = _ints(r["who"]), _ints(r["ids"]), _ints(r["labels"]), shape.matrix(r["vectors"], r["m"])
            whose, window, floor, ceiling = (_ints(r[c]) for c in ("whose", "windows", "floors", "ceilings"))
            scores, able = shape.product(vectors, theirs.T), (labels[:, None] == their_labels[None]) == same_label
            if same_label:
                able[_itself(ids, vectors, their_ids, theirs)] = False
            n = r["n"]
            ranked = scores * n + np.arange(n)  # a score and, on ties, the later place: one number
            for first in range(0, len(whose), 256):
                part = slice(first, first + 256)
                of = whose[part]
                inside = able[of] & (scores[of] >= floor[part, None]) & (scores[of] <= ceiling[part, None])
                nothing = ranked.min() - 1
                best = np.sort(np.where(inside.astype(bool), ranked[of], nothing), axis=1)[:, -most:]
                w, k = np.nonzero((best != nothing).astype(bool))
                top = best[w, k]
                out["grp"] += [r["grp"]] * len(w)
                out["who"] += who[of[w]].tolist()
                out["window"] += window[part][w].tolist()
                out["score"] += [int(t) // n for t in top]
                out["vec_id"] += their_ids[[int(t) % n for t in top]].tolist()
        return out

    theirs = blocks.select("block", "n", F.col("ids").alias("their_ids"), F.col("labels").alias("their_labels"), F.col("vectors").alias("their_vectors"))
    found = map_columns(chosen.join(theirs, "block"), work, "grp long, who long, window long, score long, vec_id long", 8)
    place = F.row_number().over(W.partitionBy("grp", "who", "window").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= most)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for vec_id, label and vector (whole numbers).

    Anchors are the rows for which ``anchor`` holds.  A row's score is its inner product with the anchor;
    ties go to the smaller vec_id.  An anchor's positives are its ``positives`` best other rows of its label;
    for each, the ``negatives`` best rows of other labels with a score from ``low`` to ``high`` hundredths of
    the positive's.  All rows are searched, exactly.

    Rows with a null label or vector take no part; a null vec_id counts as smaller than all others.  Of equal rows (id,
    label and vector) one counts; rows that share only their id are rows of their own.  Missing components
    of shorter vectors, empty ones too, count as 0.  Scores beyond longs count as the least or largest long.
    Further columns are not read; an empty table, or one without anchors, gives none.
    """
    spark = rows.sparkSession
    send_package(spark)
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    plain = plain.filter(F.col("label").isNotNull() & F.col("vector").isNotNull()).withColumn("vec_id", F.coalesce("vec_id", F.lit(NULL_ID))).distinct()
    shape = shape_of(plain)
    if shape is None:
        return spark.createDataFrame([], RESULT)
    folder = f"{checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
    blocks = write_blocks(plain, shape, folder)
    zones = blocks.select("block", "low", "high")
    groups = anchor_groups(blocks, shape, positives)
    found = cut(best_in_windows(choose_blocks(first_windows(groups), zones, shape), blocks, shape, positives, True))
    windows = negative_windows(groups, found, negatives, low, high)
    mined = best_in_windows(choose_blocks(windows, zones, shape), blocks, shape, negatives, False)

    names = map_columns(groups.select("grp", "ids"), lambda c: {"grp": [g for g, d in zip(c["grp"], c["ids"]) for _ in _ints(d)], "who": [i for d in c["ids"] for i in range(len(_ints(d)))], "anchor_id": [v for d in c["ids"] for v in _ints(d).tolist()]}, "grp long, who long, anchor_id long")
    paired = found.select("grp", "who", F.col("rank").cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, ["grp", "who"])
    known = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    result = mined.select("grp", "who", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(paired, ["grp", "who", "window"])
    result = cut(result.select(known("anchor_id"), known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score"))
    delete_folder(spark, folder)
    return result


WINDOW = "struct<who: long, window: long, floor: long, ceiling: long>"


def first_windows(groups: DataFrame) -> DataFrame:
    """One window an anchor, from its floor up."""

    def work(c: dict[str, list]) -> dict[str, list]:
        windows = [[{"who": i, "window": 0, "floor": f, "ceiling": (1 << 63) - 1} for i, f in enumerate(_ints(d).tolist())] for d in c["floors"]]
        return {k: c[k] for k in ("grp", "n", "ids", "labels", "vectors")} | {"windows": windows}

    return map_columns(groups, work, f"grp long, n int, ids binary, labels binary, vectors binary, windows array<{WINDOW}>", 16)


def negative_windows(groups: DataFrame, found: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """A window for each positive: from ``low`` hundredths of its score, or what ``negatives`` rows of the anchor's block reach, to ``high``."""
    scores = found.groupBy("grp").agg(F.collect_list(F.struct("who", F.col("rank").cast("long").alias("window"), "score")).alias("positives"))  # a few for each anchor of one group

    def work(c: dict[str, list]) -> dict[str, list]:
        out = []
        for n, near, positives in zip(c["n"], c["near"], c["positives"]):
            best, windows = _ints(near).reshape(n, -1), []
            for p in positives:
                floor, ceiling = -(-low * p["score"] // 100), high * p["score"] // 100
                if floor > ceiling:
                    continue
                inside = best[p["who"]]
                inside = inside[(inside >= floor) & (inside <= ceiling)]
                floor = max(floor, int(inside[-negatives])) if len(inside) >= negatives else floor
                windows.append({"who": p["who"], "window": p["window"], "floor": floor, "ceiling": ceiling})
            out.append(windows)
        return {k: c[k] for k in ("grp", "n", "ids", "labels", "vectors")} | {"windows": out}

    return map_columns(groups.join(scores, "grp"), work, f"grp long, n int, ids binary, labels binary, vectors binary, windows array<{WINDOW}>", 16)


ORACLE_SQL = """
WITH able AS (SELECT DISTINCT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS own, list_dot_product(a.v, b.v)::BIGINT AS score FROM able a JOIN able b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM met WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN met USING (anchor_id) WHERE NOT own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
