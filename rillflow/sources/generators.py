"""Generated inputs: sentences, random graphs, and auction data.  All by ``spark.range`` and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The sentences of the built-in word-count source, in turn.
CYCLE = ("A", "A B", "A B C", "A B C D")
WORDS = ("lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "elit", "sed", "do", "eiusmod", "tempor")


def cycle_sentences(spark: SparkSession, count: int = 200_000) -> DataFrame:
    """id, sentence: ``count`` sentences of the cycle, in turn."""
    return spark.range(count).select("id", F.element_at(F.array(*map(F.lit, CYCLE)), (F.col("id") % len(CYCLE) + 1).cast("int")).alias("sentence"))


def random_sentences(ids: DataFrame, seed: int = 1) -> DataFrame:
    """Adds a sentence of one to three words to a frame with ``id`` (a range, or a rate stream's ``value``)."""
    pick = lambda k: F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    size = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(3)) + 1).cast("int")
    return ids.withColumn("sentence", F.concat_ws(" ", F.slice(F.array(pick(1), pick(2), pick(3)), 1, size)))


def path_edges(spark: SparkSession, count: int) -> DataFrame:
    return spark.range(count).select(F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id"), F.lit(1).alias("hops"))


def random_edges(spark: SparkSession, count: int, vertices: int, seed: int = 1) -> DataFrame:
    """``count`` edges between different vertices in [1, vertices)."""
    drawn = spark.range(count).select((F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(vertices - 1)) + 1).alias("from_id"), (F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(vertices - 2)) + 1).alias("shift"))
    return drawn.select("from_id", (F.pmod(F.col("from_id") - 1 + F.col("shift"), F.lit(vertices - 1)) + 1).alias("to_id"), F.lit(1).alias("hops"))


def bernoulli_edges(spark: SparkSession, vertices: int, probability: float, seed: int = 1) -> DataFrame:
    """Each ordered pair of [0, vertices), loops included, with the given probability.

    Gaps between kept pairs are geometric; a vertex draws its own targets, so no pair is looked at that isn't kept.
    """
    expected = max(1, int(vertices * probability + 6 * (vertices * probability) ** 0.5 + 6))
    gap = lambda v, k: F.floor(F.log((F.pmod(F.xxhash64(v, k, F.lit(seed)), F.lit(1 << 40)) + 0.5) / (1 << 40)) / F.log(F.lit(1 - probability))).cast("long") + 1
    steps = spark.range(vertices).select(F.col("id").alias("from_id"), F.explode(F.sequence(F.lit(1), F.lit(expected))).alias("k")).withColumn("gap", gap(F.col("from_id"), F.col("k")))
    so_far = W.partitionBy("from_id").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    return steps.select("from_id", (F.sum("gap").over(so_far) - 1).alias("to_id"), F.lit(1).alias("hops")).filter(F.col("to_id") < vertices)


def auction_data(spark: SparkSession, rounds: int, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """people, auctions and bids in the usual proportions: 50 + n/10, 50 + n and 10 n."""
    h = lambda n, k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n))
    n_people, n_auctions = 50 + rounds // 10, 50 + rounds
    persons = spark.range(n_people).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("person "), F.col("id").cast("string")).alias("full_name"), F.element_at(F.array(*map(F.lit, ("Alberta", "Bavaria", "Drenthe", "Hesse"))), (h(4, 1) + 1).cast("int")).alias("province"))
    sales = spark.range(n_auctions).select(F.col("id").cast("int").alias("id"), h(n_people, 2).cast("int").alias("person_id"), h(10, 3).cast("int").alias("category_id"), F.col("id").cast("int").alias("start_time"), (F.col("id") + 60).cast("int").alias("end_time"))
    offers = spark.range(10 * rounds).select((F.col("id") / 10).cast("int").alias("time"), h(n_people, 4).cast("int").alias("person_id"), h(n_auctions, 5).cast("int").alias("auction_id"), (h(100000, 6) / 100).alias("amount"))
    return persons, sales, offers
