import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from rillflow import queries
from rillflow.plans import jobs, metrics
from rillflow.sources import files, generators
from rillflow.streaming import processors, run

DAY = dt.datetime(2024, 1, 1)


def rows_of(df):
    return sorted((tuple(None if v is None else str(v) for v in r) for r in df), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_is_its_sql(spark, small, name):
    found = queries.QUERIES[name](spark, small)
    columns = sorted(found.columns)
    if name not in queries.SQL:
        assert found.count() > 0
        return
    con = duckdb.connect()
    for table in "nation customer supplier part orders lineitem events documents".split():
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    expected = con.sql(queries.SQL[name])
    assert sorted(expected.columns) == columns
    expected = expected.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall()
    assert rows_of(found.select(*columns).collect()) == rows_of(expected)


def test_stream_survives_a_restart(spark, tmp_path):
    """A run reads only the new files; one without any gives the same table, and a batch that is run again changes nothing."""
    src, folder = str(tmp_path / "in"), str(tmp_path / "out")

    def table():
        stream = spark.readStream.schema("word STRING, count INT").parquet(src)
        found = run.run_changes(stream, folder, run.word_changes, run.word_totals)
        return {r["word"]: r["total"] for r in found.collect()}

    (tmp_path / "in").mkdir()
    assert table() == {}
    for words, expected in ((["a", "b", "a"], {"a": 2, "b": 1}), (["a", "c"], {"a": 3, "b": 1, "c": 1})):
        spark.createDataFrame([(w, 1) for w in words], "word STRING, count INT").coalesce(1).write.mode("append").parquet(src)
        assert table() == expected and table() == expected
    last = max((tmp_path / "out/state/commits").glob("[0-9]*"), key=lambda f: int(f.name))
    for f in (last, last.with_name(f".{last.name}.crc")):
        f.unlink(missing_ok=True)
    assert table() == expected


def test_updates_survive_a_restart(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for words in (["a", "b"], ["a"], []):
        if words:
            spark.createDataFrame([(w, DAY) for w in words], "word STRING, t TIMESTAMP").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("word STRING, t TIMESTAMP").parquet(src).withWatermark("t", "1 day")
        table = run.run_updates(stream.groupBy(F.window("t", "1 day")["start"].alias("day"), "word").count(), folder, ["day", "word"])
    assert {r["word"]: r["count"] for r in table.collect()} == {"a": 2, "b": 1}


@pytest.mark.parametrize("limit", [2, 3])
def test_hops_as_edges_arrive(spark, tmp_path, limit):
    import random

    r, src = random.Random(limit), str(tmp_path / "in")
    pairs = [(r.randrange(9), r.randrange(9)) for _ in range(14)]
    for i in range(0, len(pairs), 4):
        spark.createDataFrame([(*p, 1) for p in pairs[i : i + 4]], "from_id LONG, to_id LONG, hops INT").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("from_id LONG, to_id LONG, hops INT").option("maxFilesPerTrigger", 1).parquet(src)
    table = run.run_changes(stream, str(tmp_path / "out"), run.hop_changes(limit), run.hop_distances)
    best, front = {}, {(a, a) for p in pairs for a in p}
    for hops in range(1, limit + 1):
        front = {(a, d) for a, b in front for c, d in pairs if b == c}
        for p in front:
            best.setdefault(p, hops)
    assert {(x["from_id"], x["to_id"]): x["hops"] for x in table.collect()} == best


def test_progress_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(7).coalesce(1).write.parquet(src)
    query = spark.readStream.schema("id LONG").parquet(src).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = metrics.progress_rows(spark, query).collect()
    assert sum(r["rows"] for r in rows) == 7 and all(r["batch_ms"] >= r["commit_ms"] >= 0 for r in rows)


def test_session_keeps_its_state_store(spark, tmp_path):
    before = spark.conf.get(run.ROCKS[0])
    run_state(spark, tmp_path, [(1, 1)], "k LONG, t LONG", lambda df: processors.first_rows(df, "k", ["t"]))
    assert spark.conf.get(run.ROCKS[0]) == before


def run_state(spark, tmp_path, rows, schema, make):
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    return run.run_append(make(spark.readStream.schema(schema).parquet(src)), str(tmp_path / "out")).collect()


def test_leaders(spark, tmp_path):
    rows = [(0, 1, 1, 1), (0, 2, 1, 2), (0, 2, 2, 3), (0, 1, 2, 4), (0, 2, 1, 5), (0, 1, 3, 6)]
    found = run_state(spark, tmp_path, rows, "part LONG, item LONG, n LONG, t LONG", lambda df: processors.leaders(df, "part", "item", "n", {"t": "LONG"}))
    assert sorted((r["t"], r["item"], r["n"]) for r in found) == [(1, 1, 1), (3, 2, 2), (6, 1, 3)]


def test_xml(spark):
    lines = spark.createDataFrame(
        [
            ('<person id="7"><name>Ann B</name><emailaddress>a@b.c</emailaddress><address><city>X</city><province>Hesse</province></address><profile income="12.5"><interest category="3"/><interest category="4"/><business>Yes</business></profile></person>',),
            ('<open_auction id="5"><itemref item="9"/><seller person="7"/><category>3</category><quantity>1</quantity><interval><start>10</start><end>70</end></interval></open_auction>',),
            ('<open_auction id="5"><bidder><time>20</time><person_ref person="8"/><bid>3.5</bid></bidder></open_auction>',),
        ],
        "value STRING",
    )
    person = files.parse_people(lines).first()
    assert (person["id"], person["full_name"], person["profile"]["age"], person["profile"]["interests"], person["profile"]["is_business"], person["address"]["province"], person["phone_number"]) == (7, "Ann B", -1, [3, 4], True, "Hesse", None)
    assert [tuple(r) for r in files.parse_auctions(lines).collect()] == [(5, 7, 9, 3, 1, 10, 70)]
    assert [tuple(r) for r in files.parse_bids(lines).collect()] == [(20, 8, 5, 3.5)]


def test_edge_lists(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# from to\n0\t2\n0\t1\n3\t0\n")
    edges = files.read_edges(spark, str(tmp_path / "e.txt"))
    found = {r["page_id"]: r["neighbours"] for r in files.adjacency_from_edges(edges, spark, 5).collect()}
    assert found == {0: [1, 2], 1: [], 2: [], 3: [0], 4: []}


def test_generators(spark):
    words = generators.cycle_sentences(spark, 8).orderBy("id").collect()
    assert [r["sentence"] for r in words] == ["A", "A B", "A B C", "A B C D"] * 2
    assert all(1 <= len(r["sentence"].split()) <= 3 for r in generators.random_sentences(spark.range(50)).collect())
    assert all(r["from_id"] != r["to_id"] and 1 <= r["to_id"] < 30 for r in generators.random_edges(spark, 500, 30).collect())
    dense = generators.bernoulli_edges(spark, 300, 0.05)
    assert 4000 < dense.count() < 5000 and dense.filter("from_id = to_id").count() > 0 and dense.distinct().count() == dense.count()
    people, sales, bids = generators.auction_data(spark, 100)
    assert (people.count(), sales.count(), bids.count()) == (60, 150, 1000)
    assert generators.path_edges(spark, 4).filter("to_id - from_id = 1").count() == 4


def test_internal_word_count(spark):
    """The built-in generator through the word-count job."""
    words = jobs.projection(generators.cycle_sentences(spark, 40), "sentence", "id").withColumn("t", F.timestamp_seconds(F.col("id") / 4))
    per_second = jobs.word_count(words, "word", "count", "t", "1 second")
    assert {(r["word"], r["total"]) for r in per_second.collect()} == {("A", 4), ("B", 3), ("C", 2), ("D", 1)}
    lines = jobs.word_report(jobs.word_totals(words)).collect()
    assert [r["line"] for r in lines] == ["A=40", "B=30", "C=20", "D=10"]


def test_structured_topics(spark):
    def topic(*values):
        return spark.createDataFrame([(bytearray(v.encode()), DAY) for v in values], "value BINARY, timestamp TIMESTAMP")

    bids = files.events_of(topic('{"time": 3, "person_id": 8, "auction_id": 5, "amount": 2.5}', "broken"), "bids").collect()
    assert [tuple(r) for r in bids] == [(5, DAY, 3, 8, 5, 2.5)]
    people = files.events_of(topic('{"id": 7, "full_name": "Ann", "profile": {"interests": [1, 2], "age": 30}, "address": {"province": "Hesse"}}'), "people").first()
    assert (people["key"], people["profile"]["interests"], people["address"]["province"], people["email"]) == (7, [1, 2], "Hesse", None)
    assert files.events_of(topic('{"from_id": 1, "to_id": 2, "hops": 1}'), "neighbours").first()["key"] == 1
    assert files.events_of(topic('{"page_id": 4, "neighbours": [1, 2]}'), "adjacency").first()["neighbours"] == [1, 2]
    assert files.events_of(topic('{"id": 9, "person_id": 7, "start_time": 1, "end_time": 2}'), "auctions").first()["end_time"] == 2
    upper = files.events_of(topic("x"), "neighbours", lambda v: F.struct(F.length(v).alias("from_id"), F.lit(3).alias("to_id"), F.lit(1).alias("hops"))).first()
    assert (upper["key"], upper["to_id"]) == (1, 3)


def test_topic_helpers(spark):
    topic = spark.createDataFrame([(bytearray(b"hello you"), 5, DAY), (bytearray(b""), 2, DAY)], "value BINARY, partition INT, timestamp TIMESTAMP")
    assert [(r["key"], r["sentence"]) for r in files.sentences_of(topic).collect()] == [(104, "hello you"), (None, "")]
    assert [r["shard"] for r in files.shard_of_partition(topic, 3).collect()] == [2, 2]
