"""Edge lists, auction XML and Kafka topics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.exchange import shard_of

#: One element of the auction stream: a person, an auction, or an auction with a bid.
PERSON_XML = "_id INT, name STRING, emailaddress STRING, homepage STRING, creditcard STRING, address STRUCT<street: STRING, city: STRING, country: STRING, province: STRING, zipcode: STRING>, profile STRUCT<_income: DOUBLE, interest: ARRAY<STRUCT<_category: INT>>, education: STRING, gender: STRING, business: STRING, age: INT>"
AUCTION_XML = "_id INT, itemref STRUCT<_item: INT>, seller STRUCT<_person: INT>, category INT, quantity INT, interval STRUCT<start: INT, end: INT>, bidder STRUCT<time: INT, person_ref: STRUCT<_person: INT>, bid: DOUBLE>"


def adjacency_from_edges(edges: DataFrame, spark: SparkSession, pages: int | None = None) -> DataFrame:
    """page_id, neighbours (sorted): an empty list for each page of [0, pages) without an out edge."""
    lists = edges.groupBy(F.col("from_id").alias("page_id")).agg(F.sort_array(F.collect_list("to_id")).alias("neighbours"))
    if pages is None:
        return lists
    every = spark.range(pages).withColumnRenamed("id", "page_id")
    return every.join(lists, "page_id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast(lists.schema["neighbours"].dataType)))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``from to`` lines; lines with ``#`` in front are comments."""
    return spark.read.csv(path, sep="\t", comment="#", schema="from_id LONG, to_id LONG").withColumn("hops", F.lit(1))


def parse_people(lines: DataFrame, xml: str = "value") -> DataFrame:
    """person rows from XML text; a missing age is -1, other missing fields are null."""
    p = F.from_xml(F.col(xml), PERSON_XML)
    rows = lines.filter(F.ltrim(xml).startswith("<person")).select(p.alias("p"))
    profile = F.struct(F.col("p.profile.interest._category").alias("interests"), F.col("p.profile._income").alias("income"), (F.lower("p.profile.business") == "yes").alias("is_business"), F.coalesce("p.profile.age", F.lit(-1)).alias("age"), F.col("p.profile.gender").alias("gender"), F.col("p.profile.education").alias("education"))
    return rows.select(F.col("p._id").alias("id"), F.col("p.name").alias("full_name"), F.col("p.emailaddress").alias("email"), F.lit(None).cast("string").alias("phone_number"), F.col("p.homepage").alias("website"), F.col("p.creditcard").alias("credit_card"), profile.alias("profile"), F.col("p.address").alias("address"))


def _open_auctions(lines: DataFrame, xml: str) -> DataFrame:
    return lines.filter(F.ltrim(xml).startswith("<open_auction")).select(F.from_xml(F.col(xml), AUCTION_XML).alias("a"))


def parse_auctions(lines: DataFrame, xml: str = "value") -> DataFrame:
    """Elements without a bidder."""
    rows = _open_auctions(lines, xml).filter("a.bidder IS NULL")
    return rows.select(F.col("a._id").alias("id"), F.col("a.seller._person").alias("person_id"), F.col("a.itemref._item").alias("item_id"), F.col("a.category").alias("category_id"), F.col("a.quantity").alias("quantity"), F.col("a.interval.start").alias("start_time"), F.col("a.interval.end").alias("end_time"))


def parse_bids(lines: DataFrame, xml: str = "value") -> DataFrame:
    """Elements with a bidder."""
    rows = _open_auctions(lines, xml).filter("a.bidder IS NOT NULL")
    return rows.select(F.col("a.bidder.time").alias("time"), F.col("a.bidder.person_ref._person").alias("person_id"), F.col("a._id").alias("auction_id"), F.col("a.bidder.bid").alias("amount"))


def read_topic(spark: SparkSession, servers: str, topic: str, per_trigger: int | None = None) -> DataFrame:
    """A Kafka topic from its beginning as a stream; needs Spark's Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    return (reader.option("maxOffsetsPerTrigger", per_trigger) if per_trigger else reader).load()


def sentences_of(topic: DataFrame) -> DataFrame:
    """key (the first character's code), event_time, sentence from a topic of text values."""
    text = F.col("value").cast("string")
    return topic.select(F.when(F.length(text) > 0, F.ascii(text)).alias("key"), F.col("timestamp").alias("event_time"), text.alias("sentence"))


#: Values of the structured topics, and the column that is an event's key.
TOPICS = {
    "bids": ("time INT, person_id INT, auction_id INT, amount DOUBLE", "auction_id"),
    "auctions": ("id INT, person_id INT, item_id INT, category_id INT, quantity INT, start_time INT, end_time INT", "id"),
    "people": (
        "id INT, full_name STRING, email STRING, phone_number STRING, website STRING, credit_card STRING, profile STRUCT<interests: ARRAY<INT>, income: DOUBLE, is_business: BOOLEAN, age: INT, gender: STRING, education: STRING>, "
        "address STRUCT<street: STRING, city: STRING, country: STRING, province: STRING, zipcode: STRING>",
        "id",
    ),
    "neighbours": ("from_id INT, to_id INT, hops INT", "from_id"),
    "adjacency": ("page_id INT, neighbours ARRAY<INT>", "page_id"),
}


def protobuf_values(message: str, descriptor: str) -> Callable[[Column], Column]:
    """Decoding of Protobuf values, for ``events_of``; needs Spark's Protobuf package on the class path."""
    from pyspark.sql.protobuf.functions import from_protobuf

    return lambda value: from_protobuf(value, message, descFilePath=descriptor)


def events_of(topic: DataFrame, name: str, decode: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, event_time and the fields of a structured topic's values, JSON unless ``decode`` is given; unreadable values are dropped."""
    schema, key = TOPICS[name]
    value = F.from_json(F.col("value").cast("string"), schema) if decode is None else decode(F.col("value"))
    rows = topic.select(F.col("timestamp").alias("event_time"), value.alias("v")).filter(F.col(f"v.{key}").isNotNull())
    return rows.select(F.col(f"v.{key}").alias("key"), "event_time", "v.*")


def shard_of_partition(topic: DataFrame, shards: int) -> DataFrame:
    """Which of ``shards`` readers a topic's partition belongs to."""
    return topic.withColumn("shard", shard_of(F.col("partition"), shards))
