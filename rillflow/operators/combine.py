"""User aggregates of whole windows or keys, run as states that are combined before and after the shuffle.

A user gives ``zero``, ``add``, ``merge`` and ``finish``.  Each task adds its rows, slice by slice, to one state a key
and sends the states; after the shuffle the states of a key are merged one by one, and ``finish`` gives none,
one or many rows.  So a hot window sends one state a task, and no task holds more than its open states.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructType

from ..session import send_package

#: Keys whose states a task holds before it sends them on.
OPEN_STATES = 50_000


class Combinable(ABC):
    """An aggregate whose parts can be merged in any order; states are any values that pickle takes."""

    #: The columns that it reads, and those of the rows that it gives, as DDL.
    columns: list[str]
    result: str

    @abstractmethod
    def zero(self) -> Any: ...

    @abstractmethod
    def add(self, state: Any, rows: pd.DataFrame) -> Any:
        """The state with the rows of one slice, of one key."""

    @abstractmethod
    def merge(self, a: Any, b: Any) -> Any: ...

    @abstractmethod
    def finish(self, state: Any) -> Iterable[tuple]:
        """Rows in the order of ``result``."""


def partial_states(df: DataFrame, keys: list[str], aggregate: Combinable, open_states: int = OPEN_STATES) -> DataFrame:
    """keys, state: one row for each task and key, more only where a task sees over ``open_states`` keys."""
    send_package(df.sparkSession)
    chosen = df.select(*keys, *(c for c in aggregate.columns if c not in keys))
    schema = StructType([chosen.schema[k] for k in keys]).add("state", BinaryType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}

        def sent() -> pa.RecordBatch:
            rows = [(*k, pickle.dumps(s)) for k, s in states.items()]
            states.clear()
            return _batch(rows, arrow)

        for batch in batches:
            rows = batch.to_pandas()
            for places in _groups(batch, keys):
                key = tuple(batch.column(k)[int(places[0])].as_py() for k in keys)
                states[key] = aggregate.add(states[key] if key in states else aggregate.zero(), rows.iloc[places][aggregate.columns])
            if len(states) > open_states:
                yield sent()
        if states:
            yield sent()

    return chosen.mapInArrow(run, schema)


def _groups(batch: pa.RecordBatch, keys: list[str]) -> Iterable:
    """Places of the rows of each key within a batch; nulls are a key of their own."""
    if not batch.num_rows:
        return []
    if not keys:
        return [range(batch.num_rows)]
    codes = [pa.compute.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy() for k in keys]
    return pd.DataFrame(dict(enumerate(codes))).groupby(list(range(len(keys))), sort=False).indices.values()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _by_key(df: DataFrame, keys: list[str], give, schema: StructType) -> DataFrame:
    """Runs ``give(key, states)`` over each key's states, which come one by one, in the order of keys."""
    send_package(df.sparkSession)
    arrow, n = to_arrow_schema(schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for *key, packed in zip(*(batch.column(c).to_pylist() for c in range(n + 1))):
                key = tuple(key)
                if now is not None and key != now:
                    out += give(now, state)
                    state = None
                state, now = give.join(state, pickle.loads(packed)), key
                if len(out) >= 1000:
                    yield _batch(out, arrow)
                    out = []
        if now is not None:
            out += give(now, state)
        yield _batch(out, arrow)

    dealt = df.select(*keys, "state").repartition(*keys).sortWithinPartitions(*keys) if keys else df.select("state").coalesce(1)
    return dealt.mapInArrow(run, schema)


class _Give:
    """What is made of a key's merged state."""

    def __init__(self, aggregate: Combinable, finish: bool):
        self.aggregate, self.finish = aggregate, finish

    def join(self, state: Any, more: Any) -> Any:
        return more if state is None else self.aggregate.merge(state, more)

    def __call__(self, key: tuple, state: Any) -> list[tuple]:
        return [(*key, *row) for row in self.aggregate.finish(state)] if self.finish else [(*key, pickle.dumps(state))]


def merged_states(states: DataFrame, keys: list[str], aggregate: Combinable) -> DataFrame:
    """keys, state: one row a key."""
    schema = StructType([states.schema[k] for k in keys]).add("state", BinaryType())
    return _by_key(states, keys, _Give(aggregate, False), schema)


def finished(states: DataFrame, keys: list[str], aggregate: Combinable) -> DataFrame:
    """keys and the columns of ``aggregate.result``: what each key's merged state gives."""
    schema = StructType([states.schema[k] for k in keys] + StructType.fromDDL(aggregate.result).fields)
    return _by_key(states, keys, _Give(aggregate, True), schema)


def combined(df: DataFrame, keys: list[str], aggregate: Combinable) -> DataFrame:
    """A user aggregate of each key; put a window's start among the keys for windows."""
    return finished(partial_states(df, keys, aggregate), keys, aggregate)


class TopRows(Combinable):
    """The ``most`` rows with the largest ``by``, ties to the smallest ``tie``: rank, tie, by.  Rows without ``by`` don't count."""

    def __init__(self, by: str, tie: str, most: int):
        self.columns, self.most = [by, tie], most
        self.result = f"place INT, {tie} LONG, {by} DOUBLE"

    def zero(self):
        return []

    def add(self, state, rows):
        by, tie = self.columns
        top = rows.dropna(subset=[by]).sort_values([by, tie], ascending=[False, True]).head(self.most)
        return self.merge(state, [(-v, t) for v, t in zip(top[by].tolist(), top[tie].tolist())])

    def merge(self, a, b):
        return sorted(a + b)[: self.most]

    def finish(self, state):
        return [(place, int(t), -v) for place, (v, t) in enumerate(state, 1)]


class Sessions(Combinable):
    """Runs of times at most ``gap_seconds`` apart: n_session, first, last, n of each.

    A state holds disjoint runs, so at most as many as gaps fit into the window.
    """

    def __init__(self, time: str, gap_seconds: int):
        self.columns, self.gap = [time], pd.Timedelta(seconds=gap_seconds).value
        self.result = "session INT, first_ts TIMESTAMP_NTZ, last_ts TIMESTAMP_NTZ, n LONG"

    def zero(self):
        return []

    def add(self, state, rows):
        times = rows[self.columns[0]].dropna()
        return self.merge(state, [(t, t, 1) for t in times.astype("datetime64[ns]").astype("int64")])

    def merge(self, a, b):
        out: list[tuple[int, int, int]] = []
        for first, last, n in sorted(a + b):
            if out and first - out[-1][1] <= self.gap:
                before = out[-1]
                out[-1] = (before[0], max(before[1], last), before[2] + n)
            else:
                out.append((first, last, n))
        return out

    def finish(self, state):
        return [(number, pd.Timestamp(first).to_pydatetime(), pd.Timestamp(last).to_pydatetime(), n) for number, (first, last, n) in enumerate(state, 1)]


class LongestGap(Combinable):
    """The longest time without a row between two rows, if it is ``least_seconds`` or more: gap_start, gap_seconds.

    Times are kept by cells of ``least_seconds``, the first and last of each: a gap within a cell is shorter than
    asked, so the state is bounded by the window and the answer exact.  Of equal gaps the first; none gives no row.
    """

    def __init__(self, time: str, least_seconds: int):
        self.columns, self.cell = [time], pd.Timedelta(seconds=least_seconds).value
        self.result = "gap_start TIMESTAMP_NTZ, gap_seconds DOUBLE"

    def zero(self):
        return {}

    def add(self, state, rows):
        times = rows[self.columns[0]].dropna().astype("datetime64[ns]").astype("int64")
        ends = times.groupby(times // self.cell).agg(["min", "max"])
        return self.merge(state, dict(zip(ends.index.tolist(), zip(ends["min"].tolist(), ends["max"].tolist()))))

    def merge(self, a, b):
        out = dict(a)
        for cell, (first, last) in b.items():
            known = out.get(cell, (first, last))
            out[cell] = (min(first, known[0]), max(last, known[1]))
        return out

    def finish(self, state):
        ends = [state[cell] for cell in sorted(state)]
        gaps = [(first - last, -last) for (_, last), (first, _) in zip(ends, ends[1:])]
        if gaps and max(gaps)[0] >= self.cell:
            size, start = max(gaps)
            return [(pd.Timestamp(-start).to_pydatetime(), size / 1e9)]
        return []


class Quantiles(Combinable):
    """Approximate percentiles, as a sketch whose parts merge: percent, value.

    A sketch has levels of at most ``size`` values; a value of level h stands for 2**h of them.  A level that is full is
    put in order and every other value goes one level up, from the first or the second by turns.  Halving a level moves a
    rank by at most half the weight that it passes on, and the turns cancel out: with ``size`` 1024 ranks are off by
    under 0.5 % of the rows, whatever the values, as tested; up to ``size`` values are exact.  A state holds ``size``
    values for each doubling of the rows.  Rows without a value do not count.
    """

    def __init__(self, value: str, percents: tuple[float, ...] = (50, 90, 95, 99), size: int = 1024):
        self.columns, self.percents, self.size = [value], percents, size
        self.result = "percent DOUBLE, value DOUBLE"

    def zero(self):
        return [], 0

    def _settled(self, levels: list[np.ndarray], turn: int):
        at = 0
        while at < len(levels):
            held = levels[at]
            if len(held) > self.size:
                held = np.sort(held)
                last = held[len(held) & ~1 :]  # of an odd number one stays
                if at + 1 == len(levels):
                    levels.append(np.empty(0))
                levels[at + 1] = np.concatenate([levels[at + 1], held[turn : len(held) & ~1 : 2]])
                levels[at], turn = last, 1 - turn
            at += 1
        return levels, turn

    def add(self, state, rows):
        return self.merge(state, ([rows[self.columns[0]].dropna().to_numpy(np.float64)], 0))

    def merge(self, a, b):
        (one, turn), (two, other) = a, b
        none = np.empty(0)
        longest = max(len(one), len(two))
        pad = lambda levels: [*levels, *[none] * (longest - len(levels))]
        return self._settled([np.concatenate(pair) for pair in zip(pad(one), pad(two))], turn ^ other)

    def finish(self, state):
        values = np.concatenate([*state[0], np.empty(0)])
        if not len(values):
            return []
        weights = np.repeat(2.0 ** np.arange(len(state[0])), [len(level) for level in state[0]])
        order = np.argsort(values, kind="stable")
        until = np.cumsum(weights[order])
        places = np.searchsorted(until, np.array(self.percents) / 100 * until[-1], side="left")
        return [(float(p), float(values[order[min(at, len(values) - 1)]])) for p, at in zip(self.percents, places)]
