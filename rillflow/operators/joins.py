"""Inner joins of two event tables.  Spark picks broadcast or sort-merge by measured size; skew is split at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Pairs with equal keys, as the columns of both."""
    return left.join(right, F.col(left_key) == F.col(right_key))


def join_within(left: DataFrame, right: DataFrame, left_key: str, right_key: str, time: str, start: Column, end: Column) -> DataFrame:
    """Pairs with equal keys whose ``time`` lies strictly between ``start`` and ``end``."""
    return left.join(right, (F.col(left_key) == F.col(right_key)) & (F.col(time) > start) & (F.col(time) < end))


def join_near(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs with equal keys at most ``seconds`` apart; batch and stream (both sides need a watermark there).

    Times fall into cells of ``seconds``; each right row stands in its own cell and both neighbours, so a
    key's rows are compared within cells only and a hot key is dealt out by them.
    """
    cell = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    gap = F.expr(f"INTERVAL {int(seconds)} SECONDS")
    near = (F.col(left_time) >= F.col(right_time) - gap) & (F.col(left_time) <= F.col(right_time) + gap)
    placed = right.withColumn("__near", F.explode(F.array(cell(right_time) - 1, cell(right_time), cell(right_time) + 1)))
    return left.withColumn("__cell", cell(left_time)).join(placed, (F.col(left_key) == F.col(right_key)) & (F.col("__cell") == F.col("__near")) & near).drop("__cell", "__near")


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, width: int) -> DataFrame:
    """Pairs of whole numbers at most ``width`` apart, without an equality of their own.

    Values fall into cells of ``width``; each right row stands in its own cell and both neighbours, so
    every pair meets in exactly one cell and the join has a key to shuffle and split by.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    near = right.withColumn("__cell", F.explode(F.array(cell(right_value) - 1, cell(right_value), cell(right_value) + 1)))
    return left.withColumn("__cell", cell(left_value)).join(near, "__cell").filter(F.abs(F.col(left_value) - F.col(right_value)) <= width).drop("__cell")
