"""The queries of the training-data operators, with production parameters over whole tables.

What nulls, empty and very long texts, ties, repeated rows, empty tables and further columns give is told by
the operator that each query calls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, importance, media, mixing, neardup, negatives, pages, pieces, quality, rules, secrets, substrings, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


#: Target weights of the production mixture: domains of the sources, and weights of nodes among their siblings.
MIXTURE = mixing.Targets(
    domains={f"src{i}": ("web", "books", "code", "talk")[i % 4] for i in range(20)},
    weights={
        ("web",): 4.0, ("books",): 2.0, ("code",): 1.5, ("talk",): 0.5,
        ("web", "en"): 3.0, ("web", "de"): 1.5, ("books", "en"): 2.0, ("books", "fr"): 2.0, ("code", "en"): 4.0,
        ("web", "en", "src0"): 0.5, ("web", "en", "src4"): 2.0, ("books", "en", "src1"): 3.0, ("talk", "es", "src3"): 2.0,
    },
)


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of documents: ``substrings.repeats``."""
    return substrings.repeats(table(spark, sf_dir, "documents"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents: ``neardup.classes``."""
    return neardup.classes(table(spark, sf_dir, "documents")).drop("digest", "component")


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and outliers by language and source: ``rules.judge``."""
    return rules.judge(table(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of piece ids and of what they decode to: ``pieces.round_trip_digests``."""
    return pieces.round_trip_digests(table(spark, sf_dir, "documents"), piece_model())


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations' windows, and of conversation -1: ``chat.format_windows``, ``chat.window_digests``."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.window_digests(chat.format_windows(turns.unionByName(chat.injection_conversation(spark)), model=piece_model()))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets, with the words of a vocabulary and of all documents as dictionary: ``secrets.learn``, ``secrets.scan``."""
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.learn(docs, word_vocabulary()))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores: ``quality.fit``, ``quality.score``."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of ``MIXTURE``: ``mixing.mix``."""
    return mixing.mix(table(spark, sf_dir, "documents"), targets=MIXTURE)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores: ``toxicity.fit``, ``toxicity.score``."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts stored as images: ``media.text_images``, ``media.media_digests``."""
    return media.media_digests(media.text_images(table(spark, sf_dir, "documents")))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, with every seventh label moved on: ``negatives.mine``."""
    rows = negatives.whole_vectors(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's texts: ``importance.learn_gains``, ``importance.resample``."""
    docs = table(spark, sf_dir, "documents")
    return importance.resample(docs, importance.learn_gains(docs, table(spark, sf_dir, "benchmark")))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: ``pages.main_text``, with the model trained on generated pages."""
    return pages.main_text(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_substrings, op2_neardup, op3_rules, op4_pieces, op5_chat, op6_secrets, op7_quality, op8_mixing, op9_toxicity, op10_media, op11_negatives, op12_importance, op13_main_text)}


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": mixing.oracle_sql(targets=MIXTURE), "op11_negatives": negatives.ORACLE_SQL, "op12_importance": importance.oracle_sql()}
