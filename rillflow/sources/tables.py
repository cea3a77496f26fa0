"""Bids, auctions, people, edges and events as views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUCTION_DAYS = 60


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bids(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("l_orderkey").alias("auction_id"), F.col("l_linenumber").alias("bid_no"), F.col("l_suppkey").alias("bidder_id"), F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").alias("bid_time"))


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_bids(read(spark, sf_dir, "lineitem"))


def as_auctions(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("seller_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("category_id"),
        F.col("o_orderdate").alias("start_time"),
        (F.col("o_orderdate") + F.expr(f"INTERVAL {AUCTION_DAYS} DAYS")).alias("end_time"),
    )


def auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_auctions(read(spark, sf_dir, "orders"))


def as_people(customers: DataFrame) -> DataFrame:
    return customers.select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("province"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_people(read(spark, sf_dir, "customer"))


def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person_id, person_time: the day of each person's first order."""
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("person_id")).agg(F.min("o_orderdate").alias("person_time"))


def people_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All people with ``person_time``, the day of their first order; null for those without one."""
    return people(spark, sf_dir).join(first_orders(spark, sf_dir), "person_id", "left")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customer-to-supplier edges of all lines, with one hop; an id names one vertex on either side."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    found = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return found.select(F.col("o_custkey").alias("from_id"), F.col("l_suppkey").alias("to_id")).distinct().withColumn("hops", F.lit(1))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")
