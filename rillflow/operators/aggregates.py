"""Aggregates over event-time windows (left-closed, aligned to the epoch), for batch and stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .maps import cents


def window_of(time: str, size: str, slide: str | None = None) -> Column:
    return F.window(time, size, slide) if slide else F.window(time, size)


def count_by_window(df: DataFrame, keys: list[str], time: str, size: str, slide: str | None = None) -> DataFrame:
    """window_start, keys, n, max_ts."""
    found = df.groupBy(window_of(time, size, slide), *keys).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("max_ts"))
    return found.select(F.col("window.start").alias("window_start"), *keys, "n", "max_ts")


def merge_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of parts of the rows, as ``count_by_window`` gives them, as one."""
    return counts.groupBy("window_start", *keys).agg(F.sum("n").cast("long").alias("n"), F.max("max_ts").alias("max_ts"))


def sum_by_window(df: DataFrame, keys: list[str], value: str, time: str, size: str) -> DataFrame:
    """window_start, keys, total, max_ts, n; groups whose total is 0 are left out."""
    found = df.groupBy(window_of(time, size), *keys).agg(F.sum(value).cast("long").alias("total"), F.max(time).alias("max_ts"), F.count(F.lit(1)).alias("n"))
    return found.filter("total <> 0").select(F.col("window.start").alias("window_start"), *keys, "total", "max_ts", "n")


def rows_above(df: DataFrame, keys: list[str], value: str, time: str, size: str, deviations: float = 2.0) -> DataFrame:
    """Of each window and key the rows more than ``deviations`` standard deviations above its mean, with ``window_start``: none, some or many.

    A window's whole content decides, yet only its figures move: the rows are joined with them.
    """
    placed = df.withColumn("window_start", window_of(time, size)["start"])
    figures = placed.groupBy("window_start", *keys).agg((F.avg(value) + deviations * F.stddev_samp(value)).alias("__limit"))
    return placed.join(figures, ["window_start", *keys]).filter(F.col(value) > F.col("__limit")).drop("__limit")


def highest(df: DataFrame, key: str, amount: str, *carry: str) -> DataFrame:
    """The largest ``amount`` of each key with the columns of its row; ties go to the smallest of them, in this order."""
    best = F.min(F.struct((-F.col(amount)).alias("__down"), *carry)).alias("__best")
    return df.groupBy(key).agg(best).select(key, (-F.col("__best.__down")).alias(amount), *(F.col(f"__best.{c}").alias(c) for c in carry))


def average_of(df: DataFrame, key: str, amount: str, time: str) -> DataFrame:
    """key, avg_amount (exact hundredths before the division), n, max_ts."""
    return df.groupBy(key).agg(F.round(F.sum(cents(F.col(amount))) / 100 / F.count(F.lit(1)), 4).alias("avg_amount"), F.count(F.lit(1)).alias("n"), F.max(time).alias("max_ts"))
