"""Chains of stateful operators over two streams: joins within a time, then windows of windows, in append mode.

Each input has a watermark, which passes through all operators of a query: a join keeps a row while a
partner can still come, a window is given out, and its state dropped, once the watermark has passed
it.  What is open when the input ends is given out by ``run_closed``, which ends each input with a mark far in the
future; without it the query can be run again as more files come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import even_initial, odd
from ..operators.maps import cents
from ..sources import tables
from . import run

#: The time of the marks that end inputs; rows at or after it do not count.
END = "9000-01-01 00:00:00"


class Inputs:
    """The inputs of one query, each with its end mark's folder beside the query's state."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.streams = spark, folder, {}

    def _marks(self, name: str) -> str:
        return f"{self.folder}/end-{name}"

    def add(self, name: str, stream: DataFrame, time: str, lateness: str) -> DataFrame:
        """The stream with a watermark on ``time``, which also sees the input's end mark.

        No later filter goes below the watermark, where it might drop the mark: filter ``stream`` itself.
        """
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._marks(name))
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(place)
        self.streams[name] = (stream.schema, time)
        marks = self.spark.readStream.schema(stream.schema).parquet(self._marks(name))
        marked = stream.unionByName(marks).withWatermark(time, lateness)
        # a condition that is not deterministic holds back whatever else the optimiser would push through it
        return marked.filter((F.col(time) < F.lit(END).cast("timestamp")) & (F.spark_partition_id() >= 0))

    def end(self) -> None:
        for name, (schema, time) in self.streams.items():
            mark = self.spark.range(1).select(*(F.lit(END if f.name == time else None).cast(f.dataType).alias(f.name) for f in schema))
            mark.write.mode("append").parquet(self._marks(name))


def run_closed(inputs: Inputs, query: DataFrame, ended: Callable[[StreamingQuery], None] = lambda query: None, close: bool = True) -> DataFrame:
    """What a query in append mode gives out until its inputs end; with ``close=False`` until now."""
    found = run.run_append(query, inputs.folder, ended=ended)
    if close:
        inputs.end()
        found = run.run_append(query, inputs.folder, ended=ended)
    return found


def _timed(df: DataFrame, *times: str) -> DataFrame:
    """Times without a zone as the session's: watermarks need instants."""
    return df.withColumns({t: F.col(t).cast("timestamp") for t in times})


def local_items(auctions: DataFrame, people: DataFrame, within: str) -> DataFrame:
    """Auctions joined with their sellers whose time is at most ``within`` away, with ``event_time``, the later of both times.

    Both inputs have watermarks, on ``start_time`` and ``person_time``.
    """
    gap = F.expr(f"INTERVAL {within}")
    near = (F.col("start_time") >= F.col("person_time") - gap) & (F.col("start_time") <= F.col("person_time") + gap)
    return auctions.join(people, (F.col("seller_id") == F.col("person_id")) & near).withColumn("event_time", F.greatest("start_time", "person_time"))


def run_local_items(spark: SparkSession, d: str, folder: str, within: str, lateness: str, first: DataFrame | None = None, files: int = run.FILES_PER_TRIGGER, close: bool = True, ended: Callable[[StreamingQuery], None] = lambda query: None) -> DataFrame:
    """``local_items`` of orders in odd categories and of customers from provinces of even initial.

    A customer's time is that in ``first`` (person_id, person_time), else of the first of the orders that are there.
    """
    inputs = Inputs(spark, folder)
    opened = tables.as_auctions(run.stream_table(spark, d, "orders", files)).filter(odd(F.col("category_id")))
    auctions = inputs.add("auctions", _timed(opened, "start_time", "end_time"), "start_time", lateness)
    known = tables.as_people(run.stream_table(spark, d, "customer", files)).filter(even_initial(F.col("province"))).join(tables.first_orders(spark, d) if first is None else first, "person_id")
    people = inputs.add("people", _timed(known, "person_time"), "person_time", lateness)
    found = run_closed(inputs, local_items(auctions, people, within).select("id", "seller_id", "start_time", "person_time", "event_time"), ended, close)
    return found.withColumns({t: F.col(t).cast("timestamp_ntz") for t in ("start_time", "person_time", "event_time")})


def average_prices(bids: DataFrame, auctions: DataFrame, open_for: str, size: str, slide: str, tumbling: str) -> DataFrame:
    """Parts of the averages, by tumbling windows, of the prices of sliding ones: window_start, seller_id, cents, n, max_ts.

    Bids are joined with their auctions, which are open for ``open_for``; a sliding window's price of an auction is
    its highest bid, at the time of its latest.  The second aggregate goes by the sliding window, whose end is
    its event time, and by the tumbling window of the price; so a tumbling window comes in as many parts as
    sliding ones reach it, which ``averages`` adds up.
    """
    inside = (F.col("bid_time") > F.col("start_time")) & (F.col("bid_time") < F.col("start_time") + F.expr(f"INTERVAL {open_for}"))
    sold = bids.join(auctions, (F.col("auction_id") == F.col("id")) & inside).select("auction_id", "amount", "seller_id", "bid_time")
    prices = sold.groupBy(F.window("bid_time", size, slide).alias("sliding"), "auction_id").agg(F.max("amount").alias("amount"), F.max("seller_id").alias("seller_id"), F.max("bid_time").alias("latest"))
    timed = prices.withColumn("window_start", F.window(F.col("latest").cast("timestamp_ntz"), tumbling)["start"])
    return timed.groupBy("sliding", "window_start", "seller_id").agg(F.sum(cents(F.col("amount"))).alias("cents"), F.count(F.lit(1)).alias("n"), F.max("latest").alias("max_ts")).drop("sliding")


def averages(parts: DataFrame) -> DataFrame:
    """window_start, seller_id, avg_amount, n, max_ts from the parts of ``average_prices``."""
    summed = parts.groupBy("window_start", "seller_id").agg(F.sum("cents").alias("cents"), F.sum("n").cast("long").alias("n"), F.max("max_ts").cast("timestamp_ntz").alias("max_ts"))
    return summed.select("window_start", "seller_id", F.round(F.col("cents") / 100 / F.col("n"), 4).alias("avg_amount"), "n", "max_ts")


def run_average_prices(spark: SparkSession, d: str, folder: str, lateness: str, files: int = run.FILES_PER_TRIGGER, close: bool = True, ended: Callable[[StreamingQuery], None] = lambda query: None) -> DataFrame:
    """``average_prices`` of lines as bids and orders as auctions: windows of 15 days by 5, then of 5."""
    inputs = Inputs(spark, folder)
    bids = inputs.add("bids", _timed(tables.as_bids(run.stream_table(spark, d, "lineitem", files)), "bid_time").select("auction_id", "amount", "bid_time"), "bid_time", lateness)
    auctions = inputs.add("auctions", _timed(tables.as_auctions(run.stream_table(spark, d, "orders", files)), "start_time").select("id", "seller_id", "start_time"), "start_time", lateness)
    return averages(run_closed(inputs, average_prices(bids, auctions, f"{tables.AUCTION_DAYS} days", "15 days", "5 days", "5 days"), ended, close))
