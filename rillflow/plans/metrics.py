"""Latency, throughput, checkpoint and recovery figures from output records, metric logs and query progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.asof import asof_join, ticks
from ..operators.lineage import cut

THROUGHPUT_LOG = "timestamp STRING, throughput LONG"
LATENCY_LOG = "timestamp STRING, latency STRING, shard INT"
CHECKPOINT_LOG = "timestamp STRING, forced BOOLEAN, taken_ms DOUBLE, bytes LONG"
RECOVERY_LOG = "timestamp STRING, restored_ms DOUBLE, rollback_ms DOUBLE"
LOST_LOG = "timestamp STRING, message_count LONG, instance_name STRING"


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A metric log; header rows that stand between the rows are dropped, ``millis`` is the time of day."""
    names = [part.split()[0] for part in schema.split(", ")]
    raw = spark.read.csv(path, schema=", ".join(f"{n} STRING" for n in names), ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = raw.filter(F.col(names[0]).isNotNull() & ~F.lower(names[0]).startswith(names[0].lower()))
    typed = rows.select(*(F.col(n).try_cast(part.split()[1].lower().replace("long", "bigint")).alias(n) for n, part in zip(names, schema.split(", "))))
    return typed.withColumn("millis", millis_of_day(F.col("timestamp")))


def millis_of_day(time: Column) -> Column:
    """Milliseconds of HH:mm:ss:fff."""
    p = F.split(time, ":")
    return ((p[0].cast("long") * 60 + p[1].cast("long")) * 60 + p[2].cast("long")) * 1000 + F.rpad(F.substring(p[3], 1, 3), 3, "0").cast("long")


def since_start(log: DataFrame, run: list[str], starts: DataFrame) -> DataFrame:
    """``millis`` relative to each run's ``start_millis``."""
    return log.join(starts, run).withColumn("millis", F.col("millis") - F.col("start_millis")).drop("start_millis")


def latency(records: DataFrame) -> DataFrame:
    """latency_ms of output records with event_time and output_time; not above zero is null."""
    gap = (F.unix_micros("output_time") - F.unix_micros("event_time")) / 1000
    return records.withColumn("latency_ms", F.when(gap > 0, gap))


def first_per_bin(records: DataFrame, partition: str, time: str, tie: str, width: str = "333 milliseconds") -> DataFrame:
    """partition, bin and latency of the first record of each bin; the smallest ``tie`` decides."""
    return records.groupBy(partition, F.window(time, width)).agg(F.min_by("latency_ms", F.struct(time, tie)).alias("latency_ms")).select(partition, F.col("window.start").alias("bin_start"), "latency_ms")


def throughput(records: DataFrame, time: str, width: str = "333 milliseconds") -> DataFrame:
    """bin_start, n: records of each bin."""
    return records.groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("bin_start"), "n")


#: Of a group's ranks, the share by which sampled percentiles may be off: one in so many.
ACCURACY = 10_000


def summary(df: DataFrame, keys: list[str], value: str, percents: tuple[int, ...] = (90, 95, 99), accuracy: int = ACCURACY) -> DataFrame:
    """min, max, mean, percentiles (exact, linear interpolation) and sample deviation of each group; groups without values are left out.

    One pass brackets each percentile by approximate ones, which are off by a known share of the ranks at most;
    a second counts what lies between brackets, and value by value what lies in them.  So whatever the values, only
    some thousandths of a group's distinct values are put in order, or all of a group of up to ``accuracy`` rows.
    """
    v = F.col(value)
    beside = [min(max(p / 100 + side * 3 / accuracy, 0.0), 1.0) for p in percents for side in (-1, 1)]
    bounds = F.percentile_approx(v, beside, accuracy)
    plain = df.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg"), F.stddev_samp(v).alias("dev"), F.count(v).alias("n"), bounds.alias("bounds")).filter("n > 0")
    plain = cut(plain)
    placed = df.filter(v.isNotNull()).select(*keys, v.alias("v")).join(plain.select(*keys, "bounds", "n"), keys)
    inside = reduce(Column.__or__, (F.col("v").between(F.get("bounds", F.lit(2 * i)), F.get("bounds", F.lit(2 * i + 1))) for i in range(len(percents))))
    above = reduce(Column.__add__, ((F.col("v") >= F.get("bounds", F.lit(i))).cast("int") for i in range(len(beside))))
    counted = placed.groupBy(*keys, above.alias("cell"), F.when(inside | (F.col("n") <= accuracy), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    up = W.partitionBy(*keys).orderBy("cell", F.col("v").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counted.withColumn("until", F.sum("c").over(up)).filter("v IS NOT NULL").join(plain.select(*keys, "n"), keys)
    place = lambda p: (F.col("n") - 1) * F.lit(p / 100)
    holds = lambda rank: (rank < F.col("until")) & (rank >= F.col("until") - F.col("c"))
    ends = {f"{side}{p}": F.max(F.when(holds(f(place(p))), F.col("v"))) for p in percents for side, f in (("low", F.floor), ("high", F.ceil))}
    found = ranked.groupBy(*keys).agg(*(c.alias(name) for name, c in ends.items()))

    def percentile(p: int) -> Column:
        low, high = F.col(f"low{p}"), F.col(f"high{p}")
        return F.round(low + (high - low) * (place(p) - F.floor(place(p))), 6).alias(f"p{p}")

    return plain.join(found, keys).select(*keys, "min", "max", F.round("avg", 4).alias("mean"), *(percentile(p) for p in percents), F.round("dev", 4).alias("std"))


def sampled_latency(records: DataFrame, partition: str, time: str, tie: str, every_ms: int = 333, behind_ms: int = 5000, cell_seconds: float = 3600) -> DataFrame:
    """partition, tick, latency_ms: at every tick of a partition the latency of the next record delivered, at that time or later.

    Ticks run from a partition's first record to ``behind_ms`` before its last; a latency that is not above zero is
    null.  ``records`` has ``latency_ms``; a partition's records are compared by cells of ``cell_seconds``.
    """
    at = ticks(records, partition, time, every_ms, behind_ms).withColumnRenamed("tick", time)
    outputs = records.select(partition, F.col(time).cast("timestamp").alias(time), tie, "latency_ms")
    found = asof_join(at, outputs, [partition], time, tie, cell_seconds, forward=True)
    latency_ms = F.when(F.col("found.latency_ms") > 0, F.col("found.latency_ms"))
    return found.select(partition, F.col(time).cast("timestamp_ntz").alias("tick"), latency_ms.alias("latency_ms"))


def checkpoint_summary(log: DataFrame, keys: list[str], run: str) -> DataFrame:
    """Checkpoints a run (all, regular, forced), and mean and deviation of kilobytes and milliseconds, by group."""
    kb = F.round(F.col("bytes") / 1000)
    found = log.groupBy(*keys).agg(
        F.countDistinct(run).alias("runs"), F.count(F.lit(1)).alias("all"), F.count_if(~F.col("forced")).alias("plain"), F.avg(kb).alias("kb"), F.stddev_samp(kb).alias("kb_dev"), F.avg("taken_ms").alias("ms"), F.stddev_samp("taken_ms").alias("ms_dev")
    )
    total, regular = F.round(F.col("all") / F.col("runs")).cast("long"), F.round(F.col("plain") / F.col("runs")).cast("long")
    return found.select(*keys, total.alias("total"), regular.alias("regular"), (total - regular).alias("forced"), *(F.round(c).cast("long").alias(n) for c, n in ((F.col("kb"), "kb_mean"), (F.col("kb_dev"), "kb_std"), (F.col("ms"), "ms_mean"), (F.col("ms_dev"), "ms_std"))))


def recovery_summary(log: DataFrame, keys: list[str]) -> DataFrame:
    """Recovered workers, mean restore milliseconds and mean rollback seconds by group."""
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("recovered"), F.round(F.avg("restored_ms"), 3).alias("restore_ms"), F.round(F.avg(F.col("rollback_ms") / 1000), 3).alias("rollback_s"))


def progress_rows(spark: SparkSession, query) -> DataFrame:
    """Rows, rates and commit times of a streaming query's recent batches: its checkpoint figures."""
    rows = [(p["batchId"], p["timestamp"], p["numInputRows"], float(p.get("processedRowsPerSecond") or 0), p["durationMs"].get("triggerExecution", 0), p["durationMs"].get("commitOffsets", 0)) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch LONG, timestamp STRING, rows LONG, rows_per_second DOUBLE, batch_ms LONG, commit_ms LONG")
