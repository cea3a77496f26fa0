"""Longest gaps and exact quantiles of groups, as tables of tallies that add up, for batch and stream alike.

``parts`` makes the tallies of some rows, ``merged`` makes those of all parts one row each, and ``finished`` gives what the
merged ones of each group say.  All are Spark's own aggregates and windows, so many small groups cost no more than a few
large ones.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .aggregates import window_of
from .scan import MOST, running_sums


class LongestGaps:
    """The longest time without a row between two rows of a group, if it is ``least_seconds`` or more: gap_start, gap_seconds.

    Times are kept by cells of ``least_seconds``, the first and last of each: a gap within a cell is shorter than asked, so
    the answer is exact.  Of equal gaps the first; none gives no row.
    """

    def __init__(self, time: str, least_seconds: int):
        self.time, self.least = time, least_seconds

    def parts(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        placed = rows.filter(F.col(self.time).isNotNull()).withColumn("__cell", window_of(self.time, f"{self.least} seconds")["start"])
        return placed.groupBy(*keys, "__cell").agg(F.min(self.time).alias("__first"), F.max(self.time).alias("__last"))

    def merged(self, parts: DataFrame, keys: list[str]) -> DataFrame:
        return parts.groupBy(*keys, "__cell").agg(F.min("__first").alias("__first"), F.max("__last").alias("__last"))

    def finished(self, merged: DataFrame, keys: list[str]) -> DataFrame:
        before = F.lag("__last").over(W.partitionBy(*keys).orderBy("__cell"))  # as many rows as cells
        gaps = merged.withColumn("gap_start", before).withColumn("__gap", F.col("__first") - F.col("gap_start")).filter(F.col("__gap") >= F.make_dt_interval(secs=F.lit(self.least)))
        best = gaps.groupBy(*keys).agg(F.min(F.struct((-F.col("__gap")).alias("down"), "gap_start")).alias("__best"))
        return best.select(*keys, F.col("__best.gap_start").cast("timestamp_ntz").alias("gap_start"), _seconds(-F.col("__best.down")).alias("gap_seconds"))


def _seconds(span: Column) -> Column:
    """An interval in seconds, exact to the microsecond before it is made a double."""
    of = lambda part: F.extract(F.lit(part), span)
    return (((of("DAY") * 24 + of("HOUR").cast("long")) * 60 + of("MINUTE").cast("long")) * 60 + of("SECOND")).cast("double")


class Quantiles:
    """Exact percentiles: percent, value; the smallest value that so many per cent of a group's rows don't exceed.

    Equal values are counted, and a value's rank is the running sum of counts along its group's values, of which
    groups of more than ``most`` are cut into ranges.  Rows without a value do not count.
    """

    def __init__(self, value: str, percents: tuple[float, ...] = (50, 90, 95, 99), most: int = MOST):
        self.value, self.percents, self.most = value, percents, most

    def parts(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.filter(F.col(self.value).isNotNull()).groupBy(*keys, F.col(self.value).alias("__value")).agg(F.count(F.lit(1)).alias("__rows"))

    def merged(self, parts: DataFrame, keys: list[str]) -> DataFrame:
        return parts.groupBy(*keys, "__value").agg(F.sum("__rows").alias("__rows"))

    def finished(self, merged: DataFrame, keys: list[str]) -> DataFrame:
        counts = merged.select(F.struct(*keys, F.lit(0).alias("__all")).alias("__group"), "__value", "__rows")
        ranked = running_sums(counts, "__group", ["__value"], {"__upto": F.col("__rows")}, self.most)
        sizes = counts.groupBy("__group").agg(F.sum("__rows").alias("__size"))
        asked = F.array(*(F.struct(F.lit(float(p)).alias("percent"), self._rank(p).alias("rank")) for p in self.percents))
        held = F.filter(asked, lambda a: (a["rank"] <= F.col("__upto")) & (a["rank"] > F.col("__upto") - F.col("__rows")))
        found = ranked.join(sizes, "__group").select("__group", F.explode(held).alias("__asked"), F.col("__value").alias("value"))
        return found.select(*(F.col(f"__group.{k}").alias(k) for k in keys), F.col("__asked.percent").alias("percent"), "value")

    @staticmethod
    def _rank(percent: float) -> Column:
        """The rank, from 1, in whole numbers: the share of the rows, rounded up."""
        share = Fraction(str(percent)) / 100
        return F.greatest(F.lit(1), F.expr(f"(__size * {share.numerator} + {share.denominator - 1}) div {share.denominator}"))


def tallied(rows: DataFrame, keys: list[str], tally: LongestGaps | Quantiles) -> DataFrame:
    """What a tally says of each key; put a window's start among the keys for windows."""
    return tally.finished(tally.parts(rows, keys), keys)
