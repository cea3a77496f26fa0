"""Cutting lineage with reliable checkpoints, or compressed tables, in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

#: Spark deletes the shuffle files of a finished execution where this is set.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(df: DataFrame) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of our own only where it is unset."""
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = folder or tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the folder of ``spark.checkpoint.dir``; a folder of our own only where it is unset."""
    _folder(df)
    return df.checkpoint(eager=True)


def _stored(df: DataFrame, folder: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(folder)  # a frame takes the setting up when it is made
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(folder)


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage with a compressed table beside the checkpoints, which stays; the shuffle files that led to it go."""
    return _stored(df, f"{_folder(df)}/table-{uuid.uuid4().hex}")


@contextmanager
def passing(df: DataFrame) -> Iterator[DataFrame]:
    """As ``kept``, but the table goes at the end."""
    folder = f"{_folder(df)}/table-{uuid.uuid4().hex}"
    try:
        yield _stored(df, folder)
    finally:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
