"""As-of joins: each row of the left side with the last row of the right side before it, or the next after it.

Times fall into cells.  Within a cell of a key both sides stand in one order, and the last right row so far is carried
along it; what a cell begins with is the last right row of the nearest earlier cell that has one.  So a hot
key is dealt out by its cells, and only one row a cell of it is put in order as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, tie: str, cell_seconds: float, forward: bool = False) -> DataFrame:
    """left's columns and ``found``, a struct of right's columns but ``keys``: its last row at or before left's ``time`` (the first at or after it with ``forward``).

    Both sides have ``keys`` and ``time``.  Of right rows of one time the one with the largest ``tie`` counts as last, with
    ``forward`` the one with the smallest as first.  Left rows without such a row stay, with a null; so do those with a
    null key or time.  Right rows with a null time do not count.
    """
    sign = -1 if forward else 1
    at = lambda c: sign * F.unix_micros(F.col(c).cast("timestamp"))
    cell = F.floor(F.col("__at") / int(cell_seconds * 1_000_000))
    rest = [c for c in right.columns if c not in keys]
    # a right row stands before left rows of its time; among right rows of one time the last in order is the one that counts
    theirs = right.filter(F.col(time).isNotNull()).select(*keys, at(time).alias("__at"), F.lit(0).alias("__side"), (sign * F.col(tie)).alias("__tie"), F.struct(*rest).alias("__right"), F.lit(None).alias("__left"))
    ours = left.select(*keys, at(time).alias("__at"), F.lit(1).alias("__side"), F.lit(None).alias("__tie"), F.lit(None).alias("__right"), F.struct(*left.columns).alias("__left"))
    both = theirs.unionByName(ours).withColumn("__cell", cell)
    last = F.max_by("__right", F.when(F.col("__side") == 0, F.struct("__at", "__tie")))
    cells = both.groupBy(*keys, "__cell").agg(last.alias("__last"))  # one row a cell
    earlier = W.partitionBy(*keys).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    begins = cells.select(*keys, "__cell", F.last("__last", ignorenulls=True).over(earlier).alias("__begins"))
    so_far = W.partitionBy(*keys, "__cell").orderBy("__at", "__side", "__tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = both.withColumn("__so_far", F.last("__right", ignorenulls=True).over(so_far)).filter(F.col("__side") == 1)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "__cell")]
    joined = carried.alias("l").join(begins.alias("b"), same, "left").select("l.__left", "l.__at", F.coalesce("l.__so_far", "b.__begins").alias("found"))
    known = F.col("__at").isNotNull()
    for k in keys:
        known = known & F.col(f"__left.{k}").isNotNull()
    return joined.select("__left.*", F.when(known, F.col("found")).alias("found"))


def ticks(rows: DataFrame, key: str, time: str, every_ms: int, behind_ms: int) -> DataFrame:
    """key, tick: every ``every_ms`` (aligned to the epoch) from a key's first time to its last less ``behind_ms``.

    A key's ticks are made by the hour, so that a long time is dealt out before it is filled.
    """
    spans = rows.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    micros, width = (lambda c: F.unix_micros(F.col(c).cast("timestamp"))), 1000 * every_ms
    numbered = spans.select(key, F.ceil(micros("first") / width).alias("lo"), F.floor((micros("last") - 1000 * behind_ms) / width).alias("hi")).filter("lo <= hi")
    step = max(1, 3_600_000 // every_ms)
    starts = numbered.select(key, "hi", F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias("start"))
    dealt = starts.repartition(key, "start")
    each = dealt.select(key, F.explode(F.sequence("start", F.least("hi", F.col("start") + step - 1))).alias("n"))
    return each.select(key, F.timestamp_micros(F.col("n") * every_ms * 1000).alias("tick"))
