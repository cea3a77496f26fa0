"""Placement of rows on shards, fan-in and fan-out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a whole-number key: its absolute value modulo the number of shards; null for a null key."""
    return (F.abs(key.cast("decimal(20,0)")) % shards).cast("int")


def to_all_shards(df: DataFrame, shards: int, shard: str = "shard") -> DataFrame:
    """Every row once for each shard."""
    return df.withColumn(shard, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))


def place(df: DataFrame, key: str, shards: int, shard: str = "shard") -> DataFrame:
    """A row with a key on that key's shard, one with a null key on all of them."""
    own = F.array(shard_of(F.col(key), shards))
    return df.withColumn(shard, F.explode(F.when(F.col(key).isNull(), F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(own)))


def fan_in(*inputs: DataFrame) -> DataFrame:
    """All rows of all inputs, by column name."""
    return reduce(DataFrame.unionByName, inputs)
