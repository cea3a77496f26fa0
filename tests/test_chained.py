"""Streams over many batches of unordered files, and chains of stateful operators over two streams."""

import datetime as dt

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rillflow import queries
from rillflow.sources import tables
from rillflow.streaming import chained, processors, run

TABLES = ("events", "lineitem", "orders", "customer", "documents")


def rows_of(rows):
    return sorted((tuple(None if v is None else str(v) for v in r) for r in rows), key=repr)


def in_files(source, target, tables, files, seed=1):
    """The tables, each dealt at random to so many files."""
    for name in tables:
        table, r = pq.read_table(f"{source}/{name}.parquet"), np.random.default_rng(seed)
        owner = r.integers(0, files, table.num_rows)
        (target / f"{name}.parquet").mkdir(parents=True)
        for i in range(files):
            pq.write_table(table.take(np.flatnonzero(owner == i)), target / f"{name}.parquet" / f"part-{(i * 37) % files:03}.parquet")


@pytest.fixture(scope="module")
def unordered(small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("unordered")
    in_files(small, folder, TABLES, 130)
    return str(folder)


def expected(folder, name, columns):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return rows_of(con.sql(queries.SQL[name]).select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(n for n in queries.SQL if n.startswith("stream_")))
def test_streams_over_unordered_files(spark, small, unordered, name):
    found = queries.QUERIES[name](spark, unordered)
    columns = sorted(found.columns)
    assert rows_of(found.select(*columns).collect()) == expected(small, name, columns)


def state_rows(query):
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]


@pytest.mark.parametrize("job, name", [(chained.run_average_prices, "windowed_avg_price"), (chained.run_local_items, "local_item_events")])
def test_chains_restart_and_end_without_state(spark, small, tmp_path, job, name):
    """Two streams in six batches, a restart after three of them and one without news: the batch SQL, and no state at the end."""
    source, folder, ended = tmp_path / "in", str(tmp_path / "out"), []
    in_files(small, tmp_path / "all", ("lineitem", "orders", "customer"), 6, 2)
    arguments = {"lateness": "20000 days", "files": 1, "ended": ended.append}
    if job is chained.run_local_items:
        arguments |= {"within": "20000 days", "first": tables.first_orders(spark, small)}
    for step in ((0, 1, 2), (3, 4, 5)):
        for table in ("lineitem", "orders", "customer"):
            (source / f"{table}.parquet").mkdir(parents=True, exist_ok=True)
            for i in step:
                (tmp_path / "all" / f"{table}.parquet" / f"part-{i:03}.parquet").rename(source / f"{table}.parquet" / f"part-{i:03}.parquet")
        job(spark, str(source), folder, close=False, **arguments)
    job(spark, str(source), folder, close=False, **arguments)  # nothing new
    held = state_rows(ended[1])
    assert len(held) >= 3 and held[-1] > 0
    found = job(spark, str(source), folder, close=True, **arguments)
    columns = sorted(found.columns)
    assert rows_of(found.select(*columns).collect()) == expected(small, name, columns)
    assert state_rows(ended[-1])[-1] == 0 and sum(map(run.late_rows, ended)) == 0


def test_windows_are_given_out_as_time_goes_on(spark, tmp_path):
    """With files in order and a short lateness, averages come, and state goes, before the end."""
    day, start = dt.timedelta(days=1), dt.datetime(2024, 1, 1)
    auctions = [(i, i % 3, start + i * day) for i in range(120)]
    bids = [(i, 100.0 + k, start + (i + k) * day) for i in range(120) for k in (1, 2, 70)]
    for name, rows, schema, at in (("auctions", auctions, "id LONG, seller_id LONG, start_time TIMESTAMP", 2), ("bids", bids, "auction_id LONG, amount DOUBLE, bid_time TIMESTAMP", 2)):
        for part in range(12):
            own = [r for r in rows if min(11, (r[at] - start).days // 10) == part]
            spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    ended = []

    def query(folder):
        inputs = chained.Inputs(spark, str(tmp_path / folder))
        read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        b = inputs.add("bids", read("bids", "auction_id LONG, amount DOUBLE, bid_time TIMESTAMP"), "bid_time", "12 days")
        a = inputs.add("auctions", read("auctions", "id LONG, seller_id LONG, start_time TIMESTAMP"), "start_time", "12 days")
        return inputs, chained.average_prices(b, a, "60 days", "15 days", "5 days", "5 days")

    inputs, plan = query("out")
    early = chained.averages(chained.run_closed(inputs, plan, ended.append, close=False)).count()
    whole = chained.averages(chained.run_closed(inputs, plan, ended.append)).collect()
    assert 0.25 * len(whole) < early < len(whole)  # the join holds a bid back for as long as its auction may be open
    removed = sum(o["numRowsRemoved"] for p in ended[0].recentProgress for o in p["stateOperators"])
    assert removed > len(auctions) and state_rows(ended[-1])[-1] == 0
    prices = {}
    for i, amount, t in bids:
        if start + i * day < t < start + (i + 60) * day:
            days = (t - dt.datetime(1970, 1, 1)).days
            for sliding in range(days // 5 * 5 - 10, days + 1, 5):
                known = prices.get((sliding, i), (0, dt.datetime.min))
                prices[sliding, i] = (max(known[0], amount), max(known[1], t))
    sums = {}
    for (_, i), (amount, t) in prices.items():
        sums.setdefault((dt.datetime(1970, 1, 1) + (t - dt.datetime(1970, 1, 1)).days // 5 * 5 * day, i % 3), []).append((amount, t))
    assert {(r["window_start"], r["seller_id"]): (r["avg_amount"], r["n"], r["max_ts"]) for r in whole} == {k: (round(sum(a for a, _ in v) / len(v), 4), len(v), max(t for _, t in v)) for k, v in sums.items()}


def test_late_rows_are_told(spark, tmp_path):
    src, ended, day = str(tmp_path / "in"), [], dt.datetime(2024, 1, 1)
    for i, t in enumerate((day + dt.timedelta(days=9), day, day + dt.timedelta(days=20))):
        spark.createDataFrame([(1, t)], "k LONG, t TIMESTAMP").coalesce(1).write.mode("append").parquet(src)
        counts = spark.readStream.schema("k LONG, t TIMESTAMP").option("maxFilesPerTrigger", 1).parquet(src).withWatermark("t", "1 day").groupBy(F.window("t", "1 day"), "k").count()
        run.run_append(counts.select("window.start", "k", "count"), str(tmp_path / "out"), ended=ended.append)
    assert sum(map(run.late_rows, ended)) == 1


def test_changes_are_merged_and_batches_repeated(spark, tmp_path):
    """What is kept stays within a few batches, and a repeated batch, the merging one too, changes nothing."""
    src, folder = str(tmp_path / "in"), tmp_path / "out"

    def table():
        stream = spark.readStream.schema("word STRING, count INT").option("maxFilesPerTrigger", 1).parquet(src)
        return {r["word"]: r["total"] for r in run.run_changes(stream, str(folder), run.word_changes, run.word_totals, merge_every=3).collect()}

    total = {}
    for i in range(10):
        words = ["a", f"w{i % 4}", "b"][: 1 + i % 3]
        spark.createDataFrame([(w, 1) for w in words], "word STRING, count INT").coalesce(1).write.mode("append").parquet(src)
        for w in words:
            total[w] = total.get(w, 0) + 1
        assert table() == total
        last = max((folder / "state/commits").glob("[0-9]*"), key=lambda f: int(f.name))
        for f in (last, last.with_name(f".{last.name}.crc")):
            f.unlink(missing_ok=True)
        assert table() == total
    kept = sorted(f.name for f in (folder / "changes").iterdir())
    assert [f for f in kept if f.startswith("upto")] == ["upto=5", "upto=8"] and len(kept) <= 2 + 4


def test_a_failing_batch_leaves_one_copy(spark, tmp_path):
    """A batch that fails before or while it writes is run again from what was there before it."""
    src, folder, failures = str(tmp_path / "in"), str(tmp_path / "out"), ["before", "within"]

    def change(batch, before):
        found = run.word_changes(batch, before)
        if before is not None and failures:
            if failures.pop() == "before":
                raise ValueError("planned")
            return found.withColumn("total", F.when(F.raise_error(F.lit("planned")).isNull(), F.col("total")))
        return found

    def table():
        stream = spark.readStream.schema("word STRING, count INT").option("maxFilesPerTrigger", 1).parquet(src)
        return {r["word"]: r["total"] for r in run.run_changes(stream, folder, change, run.word_totals, merge_every=2).collect()}

    for words in (["a", "b"], ["a"], ["b", "c"]):
        spark.createDataFrame([(w, 1) for w in words], "word STRING, count INT").coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        with pytest.raises(Exception, match="planned"):
            table()
    assert table() == {"a": 2, "b": 2, "c": 1} == table()


def test_newest_epochs_as_they_arrive(spark, tmp_path):
    src = str(tmp_path / "in")
    for part in ([(1, 1, 3, 0.1), (2, 1, 200, 0.7)], [(1, 2, 101, 0.2), (1, 3, 3, 0.3), (1, 4, 4, 0.4)], [(1, 5, 2, 0.5), (1, 6, 4, 0.6), (2, 2, 100, 0.8)]):
        spark.createDataFrame(part, "k LONG, at LONG, epoch INT, v DOUBLE").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("k LONG, at LONG, epoch INT, v DOUBLE").option("maxFilesPerTrigger", 1).parquet(src)
    found = run.run_append(processors.newest_epoch(stream, "k", "epoch", ["at"], ["v"], 100), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 3, 0.1), (1, 3, 3, 0.1), (1, 4, 4, 0.4), (1, 6, 4, 0.4), (2, 1, 200, 0.7)]
