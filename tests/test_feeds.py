import time

import numpy as np
import pytest

from rillflow.sources import feeds


@pytest.fixture(scope="module")
def feed(spark):
    feeds.register(spark)
    return lambda **options: spark.read.format("feed").options(**{k: str(v) for k, v in options.items()}).load()


@pytest.mark.parametrize("kind, count, expected", [("cycle", 25, 25), ("sentences", 20_001, 20_001), ("path", 5, 5), ("edges", 1000, 1000), ("people", 120, 62), ("auctions", 120, 170), ("bids", 120, 1200), ("bids", 0, 0)])
def test_rows_follow_from_their_numbers(feed, kind, count, expected):
    """As many rows as there should be, the same in any partitions."""
    whole = sorted(map(tuple, feed(kind=kind, count=count, partitions=1).collect()))
    assert len(whole) == expected
    dealt = feed(kind=kind, count=count, partitions=7)
    assert sorted(map(tuple, dealt.collect())) == whole
    assert dealt.rdd.getNumPartitions() == max(1, min(7, expected))


def test_rows_are_of_their_kind(feed):
    assert [r["sentence"] for r in feed(kind="cycle", count=5).orderBy("id").collect()] == ["A", "A B", "A B C", "A B C D", "A"]
    assert [r["sentence"] for r in feed(kind="cycle", count=2, combined=2, partitions=3).orderBy("id").collect()] == ["A", "A B", "A A B A B C A B C D", "A A B A B C A B C D"]
    assert all(1 <= len(r["sentence"].split()) <= 3 for r in feed(kind="sentences", count=200).collect())
    edges = feed(kind="edges", count=500, vertices=9).collect()
    assert all(r["from_id"] != r["to_id"] and 1 <= min(r["from_id"], r["to_id"]) and max(r["from_id"], r["to_id"]) < 9 for r in edges)
    people, auctions, bids = (feed(kind=k, count=100) for k in ("people", "auctions", "bids"))
    assert auctions.join(people, auctions.person_id == people.id).count() == 150
    assert bids.join(auctions, bids.auction_id == auctions.id).count() == 1000
    assert feed(kind="bids", count=50, seed=1).collect() != feed(kind="bids", count=50, seed=2).collect()


def test_draws_are_even():
    counts = np.bincount(feeds.drawn(np.arange(100_000), 7, 10), minlength=10)
    assert counts.min() > 9600 and counts.max() < 10_400


def test_options_are_checked():
    for options in ({"kind": "x"}, {"rate": "5"}, {"partitions": "0"}, {"vertices": "2"}, {"count": "-1"}):
        with pytest.raises(ValueError):
            feeds._Reader(options)


def test_a_stream_is_stopped_and_resumed(spark, feed, tmp_path):
    """Rows come at their rate; after a stop in between each row stands once."""
    options = {"kind": "bids", "count": "600", "rate": "1500", "since": str(time.time() - 0.5), "partitions": "3"}

    def start(**trigger):
        stream = spark.readStream.format("feed").options(**options).load()
        return stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(**trigger).start()

    query = start(processingTime="0 seconds")
    try:
        deadline = time.time() + 60
        while sum(p["numInputRows"] for p in query.recentProgress) == 0 and time.time() < deadline:
            time.sleep(0.1)
    finally:
        query.stop()
    before = spark.read.parquet(str(tmp_path / "out")).count()
    assert 0 < before <= 6000
    while time.time() < float(options["since"]) + 4.5:
        time.sleep(0.1)
    query = start(availableNow=True)
    query.awaitTermination()
    expected = sorted(map(tuple, feed(kind="bids", count=600).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == expected
