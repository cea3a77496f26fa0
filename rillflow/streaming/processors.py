"""Stateful processors: running average, leader of latest counts, first row of a key, newest epoch of a key.

A batch's rows of a key are put in order by the processor: the stream's files or offsets per trigger bound them.
``run`` sets the state store that these need.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _transform(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, pandas: bool = False) -> DataFrame:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's state worker gets no archives
    grouped = df.groupBy(key)
    transform = grouped.transformWithStateInPandas if pandas else grouped.transformWithState
    return transform(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


class _RunningAverage(StatefulProcessor):
    """Sum of hundredths and count of a key; rows of a batch go by time, then id, as columns."""

    def __init__(self, key: str, value: str, order: list[str]):
        self.key, self.value, self.order = key, value, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("so_far", "cents LONG, n LONG")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cents, n = self.state.get() if self.state.exists() else (0, 0)
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        so_far = (batch[self.value] * 100).round().astype("int64").cumsum() + cents
        out = batch[self.order].assign(**{self.key: key[0]}, cents=so_far, n=range(n + 1, n + len(batch) + 1))
        self.state.update((int(so_far.iloc[-1]), n + len(batch)))
        yield out[[self.key, *self.order, "cents", "n"]]

    def close(self) -> None:
        pass


def running_average(df: DataFrame, key: str, value: str, order: dict[str, str]) -> DataFrame:
    """The running average of each key, on each row; ``order`` maps the ordering columns to their types."""
    schema = ", ".join([f"{key} LONG", *(f"{c} {t}" for c, t in order.items()), "cents LONG", "n LONG"])
    summed = _transform(df, key, _RunningAverage(key, value, list(order)), schema, pandas=True)
    return summed.select(key, *order, F.round(F.col("cents") / 100 / F.col("n"), 6).alias("running_avg"))


class _First(StatefulProcessor):
    """Whether a key has been seen; the first row by order of the batch that brings it goes on."""

    def __init__(self, columns: list[str], order: list[str]):
        self.columns, self.order = columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes BOOLEAN")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.seen.exists():
            first = min(rows, key=lambda r: [r[c] for c in self.order])
            self.seen.update((True,))
            yield Row(**{c: first[c] for c in self.columns})

    def close(self) -> None:
        pass


def first_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key that is not null."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return _transform(df.filter(F.col(key).isNotNull()), key, _First(df.columns, order), schema)


class _Leader(StatefulProcessor):
    """Every item's latest count, and whether it is the first that reached the highest."""

    def __init__(self, item: str, count: str, order: list[str]):
        self.item, self.count, self.order = item, count, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getMapState("latest", "item LONG", "n LONG")
        self.best = handle.getValueState("best", "item LONG, n LONG")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        item, n = self.best.get() if self.best.exists() else (None, -1)
        for row in sorted(rows, key=lambda r: [r[c] for c in self.order]):
            now, count = row[self.item], row[self.count]
            self.latest.updateValue((now,), (count,))
            if now == item and count < n:  # the leader fell: look through all once
                item, n = max(((k[0], v[0]) for k, v in self.latest.iterator()), key=lambda kv: (kv[1], -kv[0]))
            elif now == item or count > n:
                item, n = now, count
            if now == item:
                yield Row(**{self.item: now, self.count: count}, **{c: row[c] for c in self.order})
        if item is not None:
            self.best.update((item, n))

    def close(self) -> None:
        pass


def leaders(df: DataFrame, part: str, item: str, count: str, order: dict[str, str]) -> DataFrame:
    """Rows whose item leads all latest counts of its part (a region, say) when they arrive."""
    schema = ", ".join([f"{item} LONG", f"{count} LONG", *(f"{c} {t}" for c, t in order.items())])
    return _transform(df, part, _Leader(item, count, list(order)), schema)


class _NewestEpoch(StatefulProcessor):
    """The row of the newest epoch that a key has had, as ``filters.newest_epoch`` has it."""

    def __init__(self, key: str, epoch: str, order: list[str], carry: list[str], types: list[str], last_epoch: int):
        self.key, self.epoch, self.order, self.carry, self.last_epoch = key, epoch, order, carry, last_epoch
        self.schema = ", ".join(f"{c} {t}" for c, t in zip((epoch, *carry), types))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = tuple(self.held.get()) if self.held.exists() else None
        for row in sorted(rows, key=lambda r: [r[c] for c in self.order]):
            now = tuple(row[c] for c in (self.epoch, *self.carry))
            if held is not None and (now[0] > self.last_epoch or now[0] < held[0]):
                continue
            held = now if held is None or now[0] > held[0] else held
            yield Row(**{self.key: row[self.key]}, **{c: row[c] for c in self.order}, **dict(zip((self.epoch, *self.carry), held)))
        if held is not None:
            self.held.update(held)

    def close(self) -> None:
        pass


def newest_epoch(df: DataFrame, key: str, epoch: str, order: list[str], carry: list[str], last_epoch: int = 100) -> DataFrame:
    """``filters.newest_epoch`` for rows as they arrive; those of one batch go by ``order``."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    columns = [key, *order, epoch, *carry]
    return _transform(df.select(*columns), key, _NewestEpoch(key, epoch, order, carry, [kind[c] for c in (epoch, *carry)], last_epoch), ", ".join(f"{c} {kind[c]}" for c in columns))
