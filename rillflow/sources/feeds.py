"""Generated inputs as a data source: rows that follow from their number, in partitions, for batch and stream.

``register(spark)`` names it ``feed``; ``spark.read.format("feed")`` and ``spark.readStream.format("feed")`` take

* ``kind``: ``cycle`` (sentences in turn), ``sentences`` (random, one to three words), ``path`` and ``edges`` (a
  path's and random edges), ``people``, ``auctions`` and ``bids``;
* ``count``: rows in all; for the auction kinds rounds, which give 50 + count / 10 people, 50 + count auctions and 10 count bids;
* ``combined``: rows that follow those of ``cycle``, each with all its sentences in one;
* ``seed``, ``vertices`` (of ``edges``), ``partitions`` (of a batch);
* ``rate`` and ``since``: rows a second from a time on, in seconds of the epoch; without them all rows are there at once.

A stream's offset is the number of its rows so far, so any part of it can be read again, with the same rows.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .generators import CYCLE, WORDS

SCHEMAS = {
    "cycle": "id LONG, sentence STRING",
    "sentences": "id LONG, sentence STRING",
    "path": "from_id LONG, to_id LONG, hops INT",
    "edges": "from_id LONG, to_id LONG, hops INT",
    "people": "id INT, full_name STRING, province STRING",
    "auctions": "id INT, person_id INT, category_id INT, start_time INT, end_time INT",
    "bids": "time INT, person_id INT, auction_id INT, amount DOUBLE",
}
PROVINCES = ("Alberta", "Bavaria", "Drenthe", "Hesse")
#: Rows of a record batch.
SLICE = 10_000


def drawn(n: np.ndarray, salt: int, below: int) -> np.ndarray:
    """A whole number under ``below`` for each row number: its bits, mixed by multiplications and shifts."""
    x = n.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(below)).astype(np.int64)


def total(kind: str, count: int) -> int:
    return {"people": 50 + count // 10, "auctions": 50 + count, "bids": 10 * count}.get(kind, count)


def rows(kind: str, n: np.ndarray, count: int, seed: int, vertices: int) -> list[np.ndarray]:
    """The columns of the rows with the given numbers."""
    draw = lambda k, below: drawn(n, seed * 100 + k, below)
    if kind == "cycle":
        return [n, np.where(n < count, np.array(CYCLE, object)[n % len(CYCLE)], " ".join(CYCLE))]
    if kind == "sentences":
        words = np.array(WORDS, object)[np.stack([draw(k, len(WORDS)) for k in range(3)])]
        return [n, np.array([" ".join(w[:size]) for w, size in zip(words.T, draw(3, 3) + 1)], object)]
    if kind == "path":
        return [n, n + 1, np.ones(len(n), np.int64)]
    if kind == "edges":  # different ends in [1, vertices)
        start = draw(0, vertices - 1)
        return [start + 1, (start + 1 + draw(1, vertices - 2)) % (vertices - 1) + 1, np.ones(len(n), np.int64)]
    if kind == "people":
        return [n, np.array([f"person {i}" for i in n], object), np.array(PROVINCES, object)[draw(1, len(PROVINCES))]]
    people, auctions = total("people", count), total("auctions", count)
    if kind == "auctions":
        return [n, draw(2, people), draw(3, 10), n, n + 60]
    return [n // 10, draw(4, people), draw(5, auctions), draw(6, 100_000) / 100]


class _Part(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


class _Reader:
    """What batch and stream have in common."""

    def __init__(self, options: dict[str, str]):
        self.kind = options.get("kind", "cycle")
        if self.kind not in SCHEMAS:
            raise ValueError(f"kind must be one of {', '.join(SCHEMAS)}")
        self.count, self.seed = int(options.get("count", 200_000)), int(options.get("seed", 1))
        self.vertices, self.parts = int(options.get("vertices", 1000)), int(options.get("partitions", 4))
        self.combined = int(options.get("combined", 0)) if self.kind == "cycle" else 0
        self.rate, self.since = float(options.get("rate", 0)), float(options.get("since", 0))
        if self.count < 0 or self.parts < 1 or self.vertices < 3:
            raise ValueError("count must not be negative, partitions at least 1, vertices at least 3")
        if self.rate and not self.since:
            raise ValueError("rate needs the time of the first row, since")

    def there(self) -> int:
        """Rows that are there by now."""
        whole = total(self.kind, self.count) + self.combined
        return min(whole, int(max(0.0, time.time() - self.since) * self.rate)) if self.rate else whole

    def split(self, first: int, last: int) -> list[_Part]:
        bounds = np.linspace(first, last, min(self.parts, max(1, last - first)) + 1).astype(int).tolist()
        return [_Part(a, b) for a, b in zip(bounds, bounds[1:])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        first, last = partition.value
        kinds = {"INT": pa.int32(), "LONG": pa.int64(), "STRING": pa.string(), "DOUBLE": pa.float64()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in SCHEMAS[self.kind].split(", "))])
        for at in range(first, last, SLICE):
            columns = rows(self.kind, np.arange(at, min(at + SLICE, last)), self.count, self.seed, self.vertices)
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, schema)], schema=schema)


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> list[_Part]:
        return self.split(0, self.there())


class _Stream(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        return {"rows": self.there()}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        return self.split(start["rows"], end["rows"])

    def commit(self, end: dict) -> None:
        pass  # any part can be made again


class Feed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMAS[_Reader(self.options).kind]

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers that plan a source get no archives
    spark.dataSource.register(Feed)
