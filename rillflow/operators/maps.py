"""Flat maps and running values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import MOST, running_sums


def word_array(sentence: Column) -> Column:
    """Words between spaces, with commas and full stops read as spaces; line feeds stay inside words."""
    return F.filter(F.split(F.translate(sentence, ",.", "  "), " "), lambda w: F.length(w) > 0)


def to_words(df: DataFrame, sentence: str, *keep: str) -> DataFrame:
    """One row a word with ``count`` 1; the columns in ``keep`` are repeated."""
    return df.select(*keep, F.explode(word_array(F.col(sentence))).alias("word"), F.lit(1).alias("count"))


def unpack(df: DataFrame, column: str, name: str, *keep: str) -> DataFrame:
    """One row an array entry; null and empty arrays give none."""
    return df.select(*keep, F.explode(column).alias(name))


def cents(amount: Column) -> Column:
    """Exact hundredths of a two-decimal amount: sums of them do not depend on the order."""
    return F.round(amount * 100).cast("long")


def running_average(df: DataFrame, key: str, value: str, order: list[str], most: int = MOST) -> DataFrame:
    """The average of a key's values so far, on each row; keys of over ``most`` rows are summed by ranges of their order."""
    summed = running_sums(df, key, order, {"__cents": cents(F.col(value)), "__count": F.lit(1)}, most)
    return summed.withColumn("running_avg", F.round(F.col("__cents") / 100 / F.col("__count"), 6)).drop("__cents", "__count")
