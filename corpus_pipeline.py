"""The corpus pipeline: five training-data operators, each on what its predecessor kept.

The first four stages return the columns of ``documents``, further ones included; the last returns digests
of the token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rillflow.llm import mixing, neardup, pieces, secrets, toxicity
from rillflow.llm.common import checkpoint_dir, cut, delete_folder, table
from rillflow.llm.registry import MIXTURE, piece_model, word_vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; all others stay, null and empty texts and repeated rows too.

    Texts are scored whole.  Without labels of both classes none goes.  An empty table gives none.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the smallest doc_id's, and of that one's texts the smallest digest's.

    Null texts all stay; an empty text is a class with its exact copies; of repeated rows one stays.  Texts are
    compared whole; different texts of one doc_id are documents of their own.  An empty table gives none.
    """
    return neardup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, repeated rows too; its secrets are masked in its whole text, and n_chars follows.

    Null texts stay null, empty ones empty.  The dictionary is learned from this stage's documents.
    """
    return secrets.redact_texts(docs, secrets.learn(docs, word_vocabulary()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take, each once: half of the tokens, in one epoch.

    Null, empty and blank texts have no tokens and are not taken; rows that tie (one doc_id, lang and source)
    are taken or left together; a null lang or source is one of its own.  An empty table gives none.
    """
    return mixing.keep_mixed(docs, targets=MIXTURE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids of whole texts and of what they decode to, one row for each row.

    A null text counts as empty; texts are encoded whole, however long; further columns go.  An empty table gives none.
    """
    return pieces.round_trip_digests(docs, piece_model())


STAGES = [("toxicity", drop_toxic), ("near_dedup", one_of_each_class), ("secret_scan", mask_secrets), ("mixing", mix_sources), ("piece_encoding", encode)]

#: Learned toxicity, near-duplicate search and piece encoding are beyond SQL; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written as Parquet and read again, and deleted at the end."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    result = cut(STAGES[-1][1](spark, docs, sf_dir))
    delete_folder(spark, folder)
    return result
