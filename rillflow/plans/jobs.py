"""The ready jobs, each one function over DataFrames for batch and, where it says so, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import average_of, count_by_window, highest, sum_by_window
from ..operators.filters import even_initial, leader, odd
from ..operators.joins import join_on, join_within
from ..operators.maps import cents, to_words
from .iterate import page_rank


def projection(sentences: DataFrame, sentence: str, *keep: str) -> DataFrame:
    """Sentences to words (batch and stream)."""
    return to_words(sentences, sentence, *keep)


def word_count(words: DataFrame, word: str, count: str, time: str, size: str) -> DataFrame:
    """Total, latest time and rows of each word and window (batch; stream with a watermark)."""
    return sum_by_window(words, [word], count, time, size)


def word_totals(words: DataFrame) -> DataFrame:
    """Total of each word (batch; stream in update or complete mode)."""
    return words.groupBy("word").agg(F.sum("count").cast("long").alias("total"))


def selection(bids: DataFrame) -> DataFrame:
    """Bids on odd auctions (batch and stream)."""
    return bids.filter(odd(F.col("auction_id")))


def local_item(auctions: DataFrame, people: DataFrame) -> DataFrame:
    """Auctions of odd categories with sellers from provinces of even initial; filters stand before the join."""
    return join_on(auctions.filter(odd(F.col("category_id"))), people.filter(even_initial(F.col("province"))), "seller_id", "person_id")


def hot_item(bids: DataFrame, item: str, time: str, size: str, slide: str) -> DataFrame:
    """The item with most bids of each sliding window; the smallest id decides ties."""
    return leader(count_by_window(bids, [item], time, size, slide), ["window_start"], "n", item)


def bids_in_time(bids: DataFrame, auctions: DataFrame) -> DataFrame:
    """Bids joined with their auctions, strictly within the auctions' times."""
    return join_within(bids, auctions, "auction_id", "id", "bid_time", F.col("start_time"), F.col("end_time"))


def selling_prices(sold: DataFrame) -> DataFrame:
    """auction_id, amount, bid_no, bid_time, seller_id: the highest bid, the earliest line on ties."""
    return highest(sold, "auction_id", "amount", "bid_no", "bid_time", "seller_id")


def closing_prices(sold: DataFrame) -> DataFrame:
    """auction_id, amount, seller_id, bid_time: the highest amount and the latest bid so far; of such rows, the same again."""
    return sold.groupBy("auction_id").agg(F.max("amount").alias("amount"), F.max("seller_id").alias("seller_id"), F.max("bid_time").alias("bid_time"))


def seller_averages(prices: DataFrame) -> DataFrame:
    return average_of(prices, "seller_id", "amount", "bid_time")


def average_selling_price(bids: DataFrame, auctions: DataFrame) -> DataFrame:
    """Average of the closing prices of each seller, one price an auction."""
    return seller_averages(closing_prices(bids_in_time(bids, auctions)))


def windowed_average_price(sold: DataFrame, size: str, slide: str, tumbling: str) -> DataFrame:
    """window_start, seller_id, avg_amount, n, max_ts: averages, by tumbling windows, of the prices of sliding ones.

    A sliding window's price of an auction is its highest bid, at the time of its latest; an auction
    counts once for each sliding window that holds bids of it.
    """
    prices = sold.groupBy(F.window("bid_time", size, slide).alias("sliding"), "auction_id").agg(F.max("amount").alias("amount"), F.max("seller_id").alias("seller_id"), F.max("bid_time").alias("bid_time"))
    found = prices.groupBy(F.window("bid_time", tumbling), "seller_id").agg(F.round(F.sum(cents(F.col("amount"))) / 100 / F.count(F.lit(1)), 4).alias("avg_amount"), F.count(F.lit(1)).alias("n"), F.max("bid_time").alias("max_ts"))
    return found.select(F.col("window.start").alias("window_start"), "seller_id", "avg_amount", "n", "max_ts")


def local_item_events(auctions: DataFrame, people: DataFrame) -> DataFrame:
    """The local items with ``event_time``, the later of the auction's and the person's time."""
    return local_item(auctions, people).withColumn("event_time", F.greatest("start_time", "person_time"))


def word_report(totals: DataFrame) -> DataFrame:
    """``line``, word=total, sorted by word (by code point)."""
    return totals.orderBy("word").select(F.concat_ws("=", "word", F.col("total").cast("string")).alias("line"))


def rank_changes(edges: DataFrame, earlier: int = 5, later: int = 10, least: float = 1e-4) -> DataFrame:
    """page_id, rank: the ranks of the later epoch that differ from the earlier one's by more than ``least``."""
    before = page_rank(edges, earlier).withColumnRenamed("rank", "before")
    return page_rank(edges, later).join(before, "page_id").filter(F.abs(F.col("rank") - F.col("before")) > least).select("page_id", "rank")
