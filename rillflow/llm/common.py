"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import send_package

#: The word separators of the word-based operators: space and \t \n \v \f \r.
WORD_SEPARATORS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text that a slice of rows holds, unless one row alone has more.
SLICE_BYTES = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only where it is unset."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


#: Spark deletes the shuffle files of a finished execution where this is set.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of frames that are made and executed within go when they are done."""
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; the shuffle files that led to it go."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    with _cleaned_shuffles(spark):
        return df.select("*").checkpoint(eager=True)  # a frame takes the setting up when it is made


def stored(df: DataFrame, folder: str) -> DataFrame:
    """Cut the lineage with a compressed table, which the caller deletes; the shuffle files that led to it go."""
    with _cleaned_shuffles(df.sparkSession):
        df.select("*").write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Helper names that no column has, in any case: the given ones, lengthened where they are taken."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text only: further columns, whatever their names, do not reach an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def map_columns(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, rows: int = 512) -> DataFrame:
    """Run ``fn`` over slices of at most ``rows`` rows and ``SLICE_BYTES`` of text (columns as Python lists).

    It returns columns of any length.

    ``fn`` may also be a factory marked with ``per_task``: it is then called once a task to set up.
    """
    spark = df.sparkSession
    send_package(spark)
    arrow_schema = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn() if getattr(fn, "per_task", False) else fn
        for batch in batches:
            for part in row_slices(batch, rows):
                out = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow_schema], schema=arrow_schema)

    return df.mapInArrow(run, schema)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[list]], schema: str, rows: int = 512, most: int = SLICE_BYTES) -> DataFrame:
    """Run ``fn`` over Arrow slices of at most ``rows`` rows and ``most`` bytes of text, for work on whole columns.

    It yields the columns (Arrow or NumPy arrays) of any number of batches.
    """
    spark = df.sparkSession
    send_package(spark)
    arrow_schema = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, rows, most):
                for columns in fn(part):
                    yield arrow_batch(columns, arrow_schema)

    return df.mapInArrow(run, schema)


def arrow_batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of Arrow or NumPy arrays, or None for a column of nulls."""
    rows = next(len(c) for c in columns if c is not None)
    arrays = [pa.nulls(rows, f.type) if c is None else c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def lists_of(counts: np.ndarray, fields: list, kind: pa.DataType) -> pa.Array:
    """A column of lists of structs from the number of structs in each row, and their fields one after another."""
    inner = kind.value_type
    structs = pa.StructArray.from_arrays([pa.array(v, type=f.type) for v, f in zip(fields, inner)], fields=list(inner))
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), structs, type=kind)


def list_fields(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The number of structs in each row of a column of lists without nulls, and their fields one after another."""
    counts = np.diff(column.offsets.to_numpy())
    structs = column.flatten()
    return counts, {f.name: v.to_numpy(zero_copy_only=False) for f, v in zip(structs.type, structs.flatten())}


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, one after another, and the ends of the strings behind a 0."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def row_slices(batch: pa.RecordBatch, rows: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and ``most`` bytes of text; a row is never cut."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + most, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


def per_task(fn):
    fn.per_task = True
    return fn


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def sorted_spans(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    """kind:start:end joined by commas, by start, then by the order of ``kinds``, then by end."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))
