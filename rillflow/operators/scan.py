"""Running values and neighbours along a key's order, with hot keys cut into ranges.

A window function needs a key's rows in order in one task.  Keys of more than ``most`` rows are therefore
dealt by ranges of (key, order), whose bounds Spark samples; a range's part of a key is put in order on its own.  What
comes before a part is carried in as sums of the parts before it (``carried``), and the rows beside it as
copies of a few rows of its neighbours (``with_halo``).  Other keys are parts as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .lineage import cut

#: Rows of a key that one task puts in order.
MOST = 1 << 20
#: Names of the columns that parts and halos add.
PART, OWN = "__part", "__own"


def in_parts(df: DataFrame, key: str, order: list[str], most: int = MOST) -> DataFrame:
    """Adds ``__part``: 0 for keys of at most ``most`` rows, the number of a row's range for others, from 1 and in the key's order.

    The hot keys number at most the rows divided by ``most``.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
    hot = counts.select(F.col(key).alias("__key"), F.col("__n").alias("__size")).persist()
    try:
        keys, rows = hot.agg(F.count(F.lit(1)), F.sum("__size")).first()
        if not keys:
            return df.withColumn(PART, F.lit(0))
        listed = F.broadcast(hot.select("__key")) if keys <= 10_000 else hot.select("__key")
        same = F.col(key).eqNullSafe(F.col("__key"))
        # half of what a task may hold, since sampled bounds are not exact
        dealt = df.join(listed, same).drop("__key").repartitionByRange(max(2, -(-2 * rows // most)), key, *order)
        parted = cut(dealt.withColumn(PART, F.spark_partition_id() + 1))
    finally:
        hot.unpersist()
    return df.join(listed, same, "left_anti").withColumn(PART, F.lit(0)).unionByName(parted)


def along(key: str, order: list[str]) -> WindowSpec:
    """The order of a key's part."""
    return W.partitionBy(key, PART).orderBy(*order)


def _part_totals(parts: DataFrame, key: str, totals: dict[str, Column]) -> DataFrame:
    """__key, __of and each total over all earlier parts, for the parts of hot keys: one row a part."""
    per_part = parts.filter(F.col(PART) > 0).groupBy(F.col(key).alias("__key"), F.col(PART).alias("__of")).agg(*(c.alias(n) for n, c in totals.items()))
    before = W.partitionBy("__key").orderBy("__of").rowsBetween(W.unboundedPreceding, -1)  # as many rows as parts
    return per_part.withColumns({f"{n}_before": F.coalesce(F.sum(n).over(before), F.lit(0)) for n in totals})


def running_sums(df: DataFrame, key: str, order: list[str], sums: dict[str, Column], most: int = MOST) -> DataFrame:
    """Adds the sum so far, along the key's order, of each of ``sums``; ``order`` must tell rows apart."""
    parts = in_parts(df.withColumns({f"__add_{n}": c for n, c in sums.items()}), key, order, most)
    totals = _part_totals(parts, key, {f"__{n}": F.sum(f"__add_{n}") for n in sums})
    so_far = along(key, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    within = parts.withColumns({n: F.sum(f"__add_{n}").over(so_far) for n in sums})
    carried = within.join(totals.select("__key", "__of", *(f"__{n}_before" for n in sums)), F.col(key).eqNullSafe(F.col("__key")) & (F.col(PART) == F.col("__of")), "left")
    return carried.select(*df.columns, *((F.col(n) + F.coalesce(f"__{n}_before", F.lit(0))).alias(n) for n in sums))


def running_before(parts: DataFrame, key: str, order: list[str], maxima: dict[str, Column]) -> DataFrame:
    """Adds, for rows with ``__part``, the largest value before each row along its key's order; null if there is none."""
    named = parts.withColumns({f"__max_{n}": c for n, c in maxima.items()})
    per_part = named.filter(F.col(PART) > 0).groupBy(F.col(key).alias("__key"), F.col(PART).alias("__of")).agg(*(F.max(f"__max_{n}").alias(f"__of_{n}") for n in maxima))
    earlier = W.partitionBy("__key").orderBy("__of").rowsBetween(W.unboundedPreceding, -1)
    carried = per_part.select("__key", "__of", *(F.max(f"__of_{n}").over(earlier).alias(f"__carried_{n}") for n in maxima))
    before = along(key, order).rowsBetween(W.unboundedPreceding, -1)
    within = named.withColumns({n: F.max(f"__max_{n}").over(before) for n in maxima})
    joined = within.join(carried, F.col(key).eqNullSafe(F.col("__key")) & (F.col(PART) == F.col("__of")), "left")
    return joined.select(*parts.columns, *(F.greatest(n, f"__carried_{n}").alias(n) for n in maxima))


def with_halo(df: DataFrame, key: str, order: list[str], reach: int, most: int = MOST) -> DataFrame:
    """Adds ``__part`` and ``__own``: each part of a hot key also has copies, not its own, of the ``reach`` rows on either side of it.

    So window functions over ``along`` that look at most so far give own rows the values of the whole key.  A
    copy may come from beyond the next part, where that is shorter than ``reach``.
    """
    parts = in_parts(df, key, order, most)
    own = parts.withColumn(OWN, F.lit(True))
    hot = parts.filter(F.col(PART) > 0)
    totals = _part_totals(hot, key, {"__rows": F.count(F.lit(1))})
    place = F.row_number().over(along(key, order))
    placed = hot.withColumn("__place", place).join(totals, F.col(key).eqNullSafe(F.col("__key")) & (F.col(PART) == F.col("__of"))).drop("__key", "__of")
    # only a part's first and last rows can be copies elsewhere; their places in the whole key
    edges = placed.filter((F.col("__place") <= reach) | (F.col("__place") > F.col("__rows") - reach)).withColumn("__at", F.col("__place") + F.col("__rows_before")).drop("__place", "__rows", "__rows_before")
    into = totals.select("__key", "__of", (F.col("__rows_before") + 1).alias("__first"), (F.col("__rows_before") + F.col("__rows")).alias("__last"))
    beside = ((F.col("__at") < F.col("__first")) & (F.col("__first") - F.col("__at") <= reach)) | ((F.col("__at") > F.col("__last")) & (F.col("__at") - F.col("__last") <= reach))
    copies = edges.join(into, F.col(key).eqNullSafe(F.col("__key")) & (F.col(PART) != F.col("__of")) & beside)
    return own.unionByName(copies.select(*df.columns, F.col("__of").alias(PART), F.lit(False).alias(OWN)))
