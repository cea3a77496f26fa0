"""Running jobs as streams over files, with results that survive a repeated batch and a quiet restart."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

#: The only state store that keeps values, maps and lists of a processor.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Files of a micro-batch: what a task holds of a key in one batch follows from it.
FILES_PER_TRIGGER = 64

#: Batches after which the changes of a table are merged into one.
MERGE_EVERY = 16

Change = Callable[[DataFrame, DataFrame | None], DataFrame]


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """A table of Parquet files as a stream; files already there are read first."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern may stand for one file, a plain path only for a folder


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only in a local session where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp(prefix='spark-stream-')}/stream-{uuid.uuid4().hex}"


def _run(spark: SparkSession, writer: DataStreamWriter, folder: str) -> StreamingQuery:
    """Run what is there to its end.  A query keeps the state store that is set when it starts; the session's setting stays."""
    before = spark.conf.get(ROCKS[0])
    spark.conf.set(*ROCKS)
    try:
        query = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(ROCKS[0], before)
    query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were dropped, over the recent batches of a query."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def run_append(df: DataFrame, folder: str, out: str | None = None, ended: Callable[[StreamingQuery], None] = lambda query: None) -> DataFrame:
    """Run what is there to its end into Parquet files; the file sink's log makes repeated batches harmless.

    ``ended`` is told of the query, for ``late_rows`` or ``metrics.progress_rows``.
    """
    out = out or f"{folder}/out"
    ended(_run(df.sparkSession, df.writeStream.format("parquet").option("path", out), folder))
    return df.sparkSession.read.schema(df.schema).parquet(out)


class Changes:
    """A table kept as what its batches change, under one folder.

    ``batch=N`` holds the changes of one batch, ``upto=N`` all changes until then, merged.  A folder counts once it is
    complete.  What a merge took up goes at the next merge but one, so that the batch that merged can be repeated.
    """

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{name}" if name else self.place)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, kind: str) -> list[int]:
        files, top = self._path()
        if not files.exists(top):
            return []
        found = [status.getPath().getName() for status in files.listStatus(top)]
        numbers = (int(name.split("=")[1]) for name in found if name.startswith(f"{kind}="))
        return sorted(n for n in numbers if files.exists(self._path(f"{kind}={n}/_SUCCESS")[1]))

    def rows(self, before: int = 1 << 62) -> DataFrame | None:
        """The changes of all batches under ``before``, with ``batch``; None if there are none."""
        merged = [n for n in self._numbers("upto") if n < before]
        since = merged[-1] if merged else -1
        parts = [self.spark.read.parquet(f"{self.place}/upto={since}").withColumn("batch", F.lit(since).cast("long"))] if merged else []
        later = [f"{self.place}/batch={n}" for n in self._numbers("batch") if since < n < before]
        if later:
            rows = self.spark.read.option("basePath", self.place).parquet(*later)
            parts.append(rows.withColumn("batch", F.col("batch").cast("long")))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def put(self, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.place}/batch={number}")

    def merge(self, number: int, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Merge everything up to a batch into one table."""
        older = [n for n in self._numbers("upto") if n < number]
        merge(self.rows(number + 1)).drop("batch").write.mode("overwrite").parquet(f"{self.place}/upto={number}")
        if older:
            gone = [f"batch={n}" for n in self._numbers("batch") if n <= older[-1]] + [f"upto={n}" for n in older[:-1]]
            for name in gone:
                files, path = self._path(name)
                files.delete(path, True)


def run_changes(df: DataFrame, folder: str, change: Change, merge: Callable[[DataFrame], DataFrame], mode: str = "append", merge_every: int = MERGE_EVERY) -> DataFrame:
    """A table kept as the changes that each batch makes: ``merge`` of all changes so far, with their ``batch``.

    ``change`` makes a batch's changes from it and the changes before it (None for the first); it must not matter
    to ``merge`` in which batches rows came.  A batch writes its changes once, under its own number, from what
    earlier batches wrote: repeated, it writes the same again.  Every ``merge_every`` batches the changes so far become
    one table, so that a batch reads at most so many.  A run without new data gives the table of the runs before it.
    """
    spark, table = df.sparkSession, Changes(df.sparkSession, f"{folder}/changes")

    def put(batch: DataFrame, number: int) -> None:
        table.put(number, change(batch, table.rows(number)))
        if (number + 1) % merge_every == 0:
            table.merge(number, merge)

    _run(spark, df.writeStream.outputMode(mode).foreachBatch(put), folder)
    rows = table.rows()
    return merge(change(spark.createDataFrame([], df.schema), None).withColumn("batch", F.lit(0).cast("long")) if rows is None else rows)


def run_updates(df: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """The rows of an aggregate as they were last updated; only rows that a batch changes are written, and its watermark ends its state."""
    rest = [c for c in df.columns if c not in keys]

    def latest(changes: DataFrame) -> DataFrame:
        last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
        return last.select(*keys, "last.*")

    return run_changes(df, folder, lambda batch, _: batch, latest, "update")


def word_changes(batch: DataFrame, before: DataFrame | None) -> DataFrame:
    """A batch's totals of words: what it adds."""
    return batch.groupBy("word").agg(F.sum("count").cast("long").alias("total"))


def word_totals(changes: DataFrame) -> DataFrame:
    return changes.groupBy("word").agg(F.sum("total").cast("long").alias("total"))


def hop_changes(limit: int) -> Change:
    """The pairs that a batch of edges brings within ``limit`` hops, or nearer.

    A path with a new edge is a known path (or none), its first new edge, and edges of either kind: only
    such paths are built.
    """

    def change(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        edges = batch.groupBy("from_id", "to_id").agg(F.min("hops").alias("hops")).filter(F.col("hops") <= limit)
        if before is None:
            known = edges.limit(0)
        else:
            known = hop_distances(before)
            edges = edges.join(known.withColumnRenamed("hops", "old"), ["from_id", "to_id"], "left").filter("old IS NULL OR hops < old").drop("old")
        steps = known.filter(F.col("hops") < limit).unionByName(edges).groupBy("from_id", "to_id").agg(F.min("hops").alias("hops"))
        paths = edges.unionByName(_joined(known, edges, limit))
        for _ in range(limit - 1):
            paths = paths.unionByName(_joined(paths, steps, limit)).groupBy("from_id", "to_id").agg(F.min("hops").alias("hops"))
        if before is None:
            return paths
        return paths.join(known.withColumnRenamed("hops", "old"), ["from_id", "to_id"], "left").filter("old IS NULL OR hops < old").drop("old")

    return change


def _joined(paths: DataFrame, steps: DataFrame, limit: int) -> DataFrame:
    onward = steps.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("next_id"), F.col("hops").alias("more"))
    return paths.join(onward, "to_id").select("from_id", F.col("next_id").alias("to_id"), (F.col("hops") + F.col("more")).alias("hops")).filter(F.col("hops") <= limit)


def hop_distances(changes: DataFrame) -> DataFrame:
    return changes.groupBy("from_id", "to_id").agg(F.min("hops").alias("hops"))
