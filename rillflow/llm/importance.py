"""Importance resampling towards a target corpus by hashed n-gram weights.

Each n-gram falls into a bucket by its CRC-32; a bucket's gain is the logarithm of how much more often the
target uses it than the corpus, and a text's weight is the sum of gains over its n-grams.  Weights with
Gumbel noise that depends on seed and doc_id alone are ranked, and the highest are drawn.

Within a task, n-grams are interned by batch in an open-addressed NumPy table (``GramTable``): their
xxhash64 keys are probed linearly, a slot's bytes verify each hit, and a slot holds its bucket and its
count.  The slot of each occurrence gathers the gains, so an n-gram is hashed to its bucket once a batch.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import send_package
from .common import cut, map_columns, row_slices, texts_of

#: Longest n-gram, buckets, words that a text needs to be drawn, hundredths drawn, seed of the noise.
LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Bytes of text that are split into words at once, and n-grams that a table takes.
PIECE_BYTES, BATCH_GRAMS = 1 << 20, 1 << 17
#: A-Z in lower case, digits, a-z and all bytes of other characters as they are; everything else separates words.
LETTERS = bytes(ord(chr(b).lower()) if chr(b) in string.ascii_uppercase else b if chr(b) in string.ascii_lowercase + string.digits or b >= 0x80 else 0x20 for b in range(256))


def word_runs(text: str) -> Iterator[list[bytes]]:
    """The words of a whole text, in lists of about ``PIECE_BYTES``."""
    data = text.encode().translate(LETTERS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def gram_batches(texts: list[str | None], longest: int, most: int = BATCH_GRAMS) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(number of its text, n-gram) of every run of 1 to ``longest`` words, in batches of about ``most``."""
    owners, sizes, grams = [], [], []

    def batch() -> tuple[np.ndarray, list[bytes]]:
        return np.repeat(np.array(owners, np.int64), np.array(sizes, np.int64)), grams

    for number, text in enumerate(texts):
        tail: list[bytes] = []
        for words in word_runs(text or ""):
            for first in range(0, len(words), most):
                part = words[first : first + most]
                before, run = len(tail), tail + part
                found = list(part)
                for n in range(2, longest + 1):
                    found += [b" ".join(run[end - n : end]) for end in range(max(n, before + 1), len(run) + 1)]
                tail = run[len(run) - min(len(run), longest - 1) :]
                owners.append(number), sizes.append(len(found))
                grams += found
                if len(grams) >= most:
                    yield batch()
                    owners, sizes, grams = [], [], []
    if grams:
        yield batch()


class GramTable:
    """The n-grams of one batch: keys, bytes, bucket and count of each slot, and the slot of each occurrence."""

    def __init__(self, grams: list[bytes], buckets: int, hashed=xxhash.xxh64_intdigest):
        capacity = 1 << max(4, (2 * len(grams)).bit_length())
        mask = capacity - 1
        self.keys, self.names = np.zeros(capacity, np.uint64), np.full(capacity, None, object)
        self.buckets, taken, claim = np.zeros(capacity, np.int32), np.zeros(capacity, bool), np.zeros(capacity, np.int64)
        names = np.empty(len(grams), object)
        names[:] = grams
        keys = np.fromiter(map(hashed, grams), np.uint64, len(grams))
        self.slots = (keys & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(grams))
        while len(todo):
            at = self.slots[todo]
            free = ~taken[at]
            new, place = todo[free], at[free]
            claim[place] = new  # of several that want a slot one gets it, the others look at it as taken
            new = new[claim[place] == new]
            place = self.slots[new]
            taken[place], self.keys[place], self.names[place] = True, keys[new], names[new]
            self.buckets[place] = np.fromiter(map(zlib.crc32, names[new]), np.uint32, len(new)) % buckets
            same = self.keys[at] == keys[todo]
            same[same] = self.names[at[same]] == names[todo[same]]
            todo = todo[~same]
            self.slots[todo] = (self.slots[todo] + 1) & mask
        self.counts = np.bincount(self.slots, minlength=capacity)

    def bucket_counts(self, buckets: int) -> np.ndarray:
        used = np.flatnonzero(self.counts)
        return np.bincount(self.buckets[used], self.counts[used], minlength=buckets).astype(np.int64)


def bucket_totals(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """target (boolean), bucket, n: n-grams by bucket of all texts of either side; a task sends at most one row a bucket and side."""
    both = texts_only(docs).withColumn("target", F.lit(False)).unionByName(texts_only(target).withColumn("target", F.lit(True)))
    send_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for part in row_slices(batch, 512):
                texts, sides = part.column("text").to_pylist(), np.array(part.column("target").to_pylist(), bool)
                for side in (0, 1):
                    for _, grams in gram_batches([t for t, s in zip(texts, sides) if s == side], longest):
                        totals[side] += GramTable(grams, buckets).bucket_counts(buckets)
        side, bucket = np.nonzero(totals)
        yield pa.RecordBatch.from_pydict({"target": pa.array(side == 1), "bucket": pa.array(bucket, pa.int32()), "n": pa.array(totals[side, bucket])})

    found = both.mapInArrow(run, "target boolean, bucket int, n long")
    return found.groupBy("target", "bucket").agg(F.sum("n").alias("n"))


def texts_only(df: DataFrame) -> DataFrame:
    return df.select(F.col("text").cast("string").alias("text"))


def learn_gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, in thousandths: ``buckets`` numbers are all that comes to the driver."""
    corpus, aim = [0.0] * buckets, [0.0] * buckets
    for row in bucket_totals(docs, target, longest, buckets).collect():
        (aim if row["target"] else corpus)[row["bucket"]] = float(row["n"])
    whole, all_aim = sum(corpus), sum(aim)
    return [math.floor(1000 * math.log((t + 1) * (whole + buckets) / ((s + 1) * (all_aim + buckets)))) for s, t in zip(corpus, aim)]


def weigh(docs: DataFrame, gains: list[int], longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight of each text; a null or empty text has zeros."""
    by_bucket, buckets = np.array(gains, np.int64), len(gains)

    def work(rows: dict[str, list]) -> dict[str, list]:
        texts = rows["text"]
        features, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for owners, grams in gram_batches(texts, longest):
            table = GramTable(grams, buckets)
            np.add.at(features, owners, 1)
            np.add.at(weight, owners, by_bucket[table.buckets[table.slots]])
        # m words make m, m - 1, ... n-grams by length
        words = features if longest == 1 else np.array([sum(map(len, word_runs(t or ""))) for t in texts], np.int64)
        return {"doc_id": rows["doc_id"], "n_words": words.tolist(), "n_features": features.tolist(), "weight": weight.tolist()}

    return map_columns(texts_of(docs), work, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise in thousandths, from the first 32 bits of SHA-256 of ``seed:doc_id``; nothing stands for a null doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The place of each row from 1, over all rows, without a task that sees them all.

    Equal rows are counted before the exchange and take neighbouring places.  Rows are dealt by ranges of
    the order; a range's first place follows from the sizes of those before it, one number a range.
    """
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    dealt = cut(counted.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before, starts = 0, []
    for range_, n in sorted((r["__range"], r["n"]) for r in dealt.groupBy("__range").agg(F.sum("__n").alias("n")).collect()):
        starts.append((range_, before))
        before += n
    place = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = dealt.withColumn("__before", F.coalesce(F.sum("__n").over(place), F.lit(0)))
    first = within.join(F.broadcast(df.sparkSession.createDataFrame(starts, "__range int, __start long")), "__range")
    return first.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__k"), "__before", "__start").select(*columns, (F.col("__start") + F.col("__before") + F.col("__k")).alias(name))


def resample(docs: DataFrame, gains: list[int], longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is 1, 2, 3... of those drawn, null for the rest.

    Of the N documents with at least ``least_words`` words, floor(N * percent / 100) are drawn: the highest
    scores, ties to the smaller doc_id.  A null or empty text has no features, weight 0 and is never
    drawn; a null doc_id stays null, draws one noise with all others and comes first among ties.  Repeated
    rows are documents of their own with neighbouring ranks.  Texts are read whole, however long; further
    columns are not read; an empty table gives none.
    """
    scored = cut(weigh(docs, gains, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = scored.filter(F.col("n_words") >= least_words).drop("n_words")
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("weight"), F.col("n_features")]
    ranked = numbered(able, order, "place").withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    rest = scored.filter(F.col("n_words") < least_words).drop("n_words").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


ORACLE_SQL = r"""
WITH crc AS (SELECT list(c ORDER BY b) AS crcs FROM (SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) r(b))),
word AS (SELECT doc_id, n, unnest(words) AS word FROM (SELECT doc_id, n, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM (SELECT doc_id, row_number() OVER () AS n, text FROM documents UNION ALL SELECT NULL, 0, text FROM benchmark))),
total AS (SELECT n, word, count(*) AS c FROM word GROUP BY ALL),
known AS (SELECT word, sum(c) FILTER (n > 0) AS s, sum(c) FILTER (n = 0) AS t FROM total GROUP BY word),
hashed AS (SELECT word, coalesce(s, 0)::BIGINT AS s, coalesce(t, 0)::BIGINT AS t, xor(list_reduce(list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || substr(hex(word), 2 * i - 1, 2))::BIGINT), lambda c, b: xor(c >> 8, crcs[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % {buckets} AS bucket FROM known, crc),
gain AS (SELECT bucket, floor(1000 * ln((sum(t) + 1)::DOUBLE * (sum(sum(s)) OVER () + {buckets})::DOUBLE / ((sum(s) + 1)::DOUBLE * (sum(sum(t)) OVER () + {buckets})::DOUBLE)))::BIGINT AS gain FROM hashed GROUP BY bucket),
weighed AS (SELECT n, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM total JOIN hashed USING (word) JOIN gain USING (bucket) WHERE n > 0 GROUP BY n),
noise AS (SELECT doc_id, row_number() OVER () AS n, floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM documents),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + noise AS score FROM noise LEFT JOIN weighed USING (n)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {least} ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (n_features >= {least}) OVER () * {percent} // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {least} AND place <= drawn THEN place END::BIGINT AS rank FROM placed
"""


def oracle_sql(buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> str:
    """For single words; DuckDB counts CRC-32 by a table of 256 remainders."""
    return ORACLE_SQL.replace("{buckets}", str(buckets)).replace("{percent}", str(percent)).replace("{least}", str(least_words)).replace("{seed}", str(seed))
