"""The jobs over streams of the given tables, run to the end of what is there.

Files may come in any order and any batches: what can be merged (counts, maxima, firsts, pairs) is kept as
changes of batches, without a watermark, so no row is ever late; what needs state has its lateness as a
parameter, and ``run.late_rows`` tells what came later still.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, combine, filters, joins, maps, tallies
from ..plans import jobs
from ..sources import tables
from . import chained, run

#: Lateness of streams that replay a table whose files are in no order: more than the time that any table spans.
ANY_ORDER = "20000 days"


def stream_echo(spark: SparkSession, d: str) -> DataFrame:
    """What comes in goes out: the pipe that other jobs are measured against."""
    return run.run_append(run.stream_table(spark, d, "documents").select("doc_id", "text"), run.shared_folder(spark))


def stream_selection(spark: SparkSession, d: str) -> DataFrame:
    bids = tables.as_bids(run.stream_table(spark, d, "lineitem"))
    return run.run_append(jobs.selection(bids).select("auction_id", "bid_no", "amount"), run.shared_folder(spark))


def stream_local_item(spark: SparkSession, d: str) -> DataFrame:
    """Auctions as they open, joined with the table of people."""
    auctions = tables.as_auctions(run.stream_table(spark, d, "orders"))
    return run.run_append(jobs.local_item(auctions, tables.people(spark, d)), run.shared_folder(spark))


def stream_local_item_events(spark: SparkSession, d: str) -> DataFrame:
    """People and auctions as they come, two streams joined within a time: ``chained.local_items``."""
    return chained.run_local_items(spark, d, run.shared_folder(spark), within=ANY_ORDER, lateness=ANY_ORDER)


def stream_windowed_avg_price(spark: SparkSession, d: str) -> DataFrame:
    """Bids and auctions joined, sliding windows and tumbling ones, as one query: ``chained.average_prices``."""
    return chained.run_average_prices(spark, d, run.shared_folder(spark), lateness=ANY_ORDER)


def _counted(spark: SparkSession, d: str, size: str, slide: str | None = None) -> DataFrame:
    """Events of each window and user: a batch adds its counts."""
    events = run.stream_table(spark, d, "events")
    return run.run_changes(events, run.shared_folder(spark), lambda batch, _: aggregates.count_by_window(batch, ["user_id"], "ts", size, slide), lambda counts: aggregates.merge_counts(counts, ["user_id"]))


def stream_hot_item(spark: SparkSession, d: str) -> DataFrame:
    """Counts of sliding windows; the leader of each window."""
    return filters.leader(_counted(spark, d, "10 hours", "1 hour"), ["window_start"], "n", "user_id")


def stream_tumbling_count(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, "1 day")


def stream_avg_price(spark: SparkSession, d: str) -> DataFrame:
    """Bids as they come, joined with the table of auctions; each batch adds its highest bids."""
    sold = jobs.bids_in_time(tables.as_bids(run.stream_table(spark, d, "lineitem")), tables.auctions(spark, d))
    prices = run.run_changes(sold, run.shared_folder(spark), lambda batch, _: jobs.closing_prices(batch), jobs.closing_prices)
    return jobs.seller_averages(prices)


def stream_word_totals(spark: SparkSession, d: str) -> DataFrame:
    words = jobs.projection(run.stream_table(spark, d, "documents"), "text")
    return run.run_changes(words, run.shared_folder(spark), run.word_changes, run.word_totals)


def stream_running_avg(spark: SparkSession, d: str) -> DataFrame:
    """The average of a user's values so far, by time, then id: a row that comes late counts where it belongs.

    Each batch adds its rows; the averages are those of ``maps.running_average``, which splits hot users.
    ``processors.running_average`` gives them by arrival instead, with one state a key.
    """
    events = run.stream_table(spark, d, "events").select("user_id", "value", "ts", "event_id")
    rows = run.run_changes(events, run.shared_folder(spark), lambda batch, _: batch, lambda changes: changes.drop("batch"))
    return maps.running_average(rows, "user_id", "value", ["ts", "event_id"]).select("user_id", "ts", "event_id", "running_avg")


def stream_distinct_by_key(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each user by time, then id; ``processors.first_rows`` gives the first to arrive instead."""
    events = run.stream_table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    first = lambda rows: filters.first_by_key(rows.select("event_id", "ts", "user_id", "event_type"), "user_id", ["ts", "event_id"])
    return run.run_changes(events, run.shared_folder(spark), lambda batch, _: first(batch), first)


def stream_near_in_time(spark: SparkSession, d: str, lateness: str = ANY_ORDER) -> DataFrame:
    """Clicks and purchases of a user within half an hour: a join of two streams with watermarks."""

    def side(kind: str, name: str) -> DataFrame:
        events = run.stream_table(spark, d, "events").filter(F.col("event_type") == kind)
        return events.select(F.col("event_id").alias(f"{name}_id"), F.col("user_id").alias(f"{name}_user"), F.col("ts").cast("timestamp").alias(f"{name}_ts")).withWatermark(f"{name}_ts", lateness)

    pairs = joins.join_near(side("click", "left"), side("purchase", "right"), "left_user", "right_user", "left_ts", "right_ts", 1800)
    return run.run_append(pairs.select("left_id", "right_id"), run.shared_folder(spark))


def stream_nhop(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within two hops as edges come: each event leads from its user to the number of its block of twenty events."""
    edges = run.stream_table(spark, d, "events").select(F.col("user_id").alias("from_id"), F.floor(F.col("event_id") / 20).alias("to_id"), F.lit(1).alias("hops"))
    return run.run_changes(edges, run.shared_folder(spark), run.hop_changes(2), run.hop_distances)


def stream_window_aggregate(spark: SparkSession, d: str, aggregate: combine.Combinable, keys: list[str], size: str) -> DataFrame:
    """A user aggregate of each window of events and ``keys``: batches add states, which are merged and finished."""
    events = run.stream_table(spark, d, "events")
    placed = lambda rows: rows.withColumn("window_start", aggregates.window_of("ts", size)["start"])
    keys = ["window_start", *keys]
    states = run.run_changes(events, run.shared_folder(spark), lambda batch, _: combine.partial_states(placed(batch), keys, aggregate), lambda changes: combine.merged_states(changes, keys, aggregate))
    return combine.finished(states, keys, aggregate)


def stream_window_tally(spark: SparkSession, d: str, tally: tallies.LongestGaps | tallies.Quantiles, keys: list[str], size: str) -> DataFrame:
    """A tally of each window of events and ``keys``: batches add their parts, which are merged and finished."""
    events = run.stream_table(spark, d, "events")
    placed = lambda rows: rows.withColumn("window_start", aggregates.window_of("ts", size)["start"])
    keys = ["window_start", *keys]
    merged = run.run_changes(events, run.shared_folder(spark), lambda batch, _: tally.parts(placed(batch), keys), lambda changes: tally.merged(changes, keys))
    return tally.finished(merged, keys)
