"""Filters, stateless and stateful.  The stateful ones are window functions here; ``streaming`` has their stream forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import MOST, in_parts, running_before


def odd(value: Column) -> Column:
    """Truncated remainder, so negative odd numbers count as odd too."""
    return value % 2 != 0


def even_initial(text: Column) -> Column:
    """Whether a text is there, is not empty and begins with a character of even code."""
    return text.isNotNull() & (F.length(text) > 0) & (F.ascii(text) % 2 == 0)


def first_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; rows with a null key are dropped.

    A combined minimum instead of a ranked window: each task sends one row a key, so hot keys cost nothing.
    """
    rest = [c for c in df.columns if c not in (key, *order)]
    first = F.min(F.struct(*order, *rest)).alias("__row")
    found = df.filter(F.col(key).isNotNull()).groupBy(key).agg(first)
    return found.select(*(F.col(c) if c == key else F.col(f"__row.{c}").alias(c) for c in df.columns))


def hash_sample(df: DataFrame, key: str, one_in: int = 5) -> DataFrame:
    """One row in ``one_in`` by the first digits of the key's MD5: the same rows on every run and in every engine."""
    return df.filter(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 7), 16, 10).cast("long") % one_in == 0)


def newest_epoch(df: DataFrame, key: str, epoch: str, order: list[str], carry: list[str], last_epoch: int = 100, most: int = MOST) -> DataFrame:
    """What passes a collector that holds one row a key, that of the newest epoch, as rows arrive by ``order``: key, order, epoch, carry.

    A key's first row passes and is held.  Of later ones, those beyond ``last_epoch`` are dropped; a newer
    epoch is held and passes, an older one is dropped, and one of the held epoch gives the held row's epoch and
    ``carry`` at its own place.  Keys of over ``most`` rows are read by ranges of their order.
    """
    parts = in_parts(df.select(key, *order, epoch, *carry), key, order, most).withColumn("__held", F.struct(epoch, *carry))
    first = F.min(F.struct(*order)).alias("__first")
    begins = df.groupBy(key).agg(first).select(F.col(key).alias("__key"), "__first")
    marked = parts.join(begins, F.col(key).eqNullSafe(F.col("__key"))).withColumn("__begins", F.struct(*order) == F.col("__first")).drop("__key", "__first")
    able = F.when(F.col("__begins") | (F.col(epoch) <= last_epoch), F.col(epoch))
    # the newest epoch before each row, then the row that brought it
    marked = running_before(marked, key, order, {"__newest": able})
    brings = F.col("__newest").isNull() | (able > F.col("__newest"))
    held = running_before(marked.withColumn("__brought", F.when(brings, F.struct(epoch, F.col("__held").alias("row")))), key, order, {"__kept": F.col("__brought")})
    passes = F.col("__begins") | ((F.col(epoch) <= last_epoch) & (F.col(epoch) >= F.col("__newest")))
    given = F.when(F.col("__begins") | (F.col(epoch) > F.col("__newest")), F.col("__held")).otherwise(F.col("__kept.row"))
    return held.filter(passes).select(key, *order, given.alias("g")).select(key, *order, *(F.col(f"g.{c}").alias(c) for c in (epoch, *carry)))


def leader(df: DataFrame, group: list[str], count: str, tie: str, *carry: str) -> DataFrame:
    """Of each group the row with the largest ``count``, with its ``carry`` columns; the smallest ``tie`` decides."""
    best = df.groupBy(*group).agg(F.max_by(F.struct(tie, *carry), F.struct(F.col(count), (-F.col(tie)).alias("t"))).alias("__best"), F.max(count).alias(count))
    return best.select(*group, f"__best.{tie}", count, *(f"__best.{c}" for c in carry))
