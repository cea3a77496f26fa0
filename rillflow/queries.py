"""The registered queries over the given tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.records import output_record
from .functions.smoothing import low_pass, savgol, savgol_weights
from .functions.smoothing import savgol_mirrored as mirrored
from .operators import aggregates, combine, exchange, filters, joins, maps, tallies
from .plans import iterate, jobs, metrics, reach, recovery
from .sources import tables
from .sources.files import adjacency_from_edges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


EDGES = "edge AS (SELECT DISTINCT o_custkey AS from_id, l_suppkey AS to_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
SOLD = "sold AS (SELECT l_orderkey AS auction_id, l_linenumber AS bid_no, o_custkey AS seller_id, l_extendedprice AS amount, l_shipdate AS bid_time FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_shipdate < o_orderdate + INTERVAL 60 DAYS)"
PRICES = f"{SOLD}, price AS (SELECT auction_id, max(amount) AS amount, max(seller_id) AS seller_id, max(bid_time) AS bid_time FROM sold GROUP BY auction_id)"
WORDS = "w AS (SELECT doc_id, unnest(string_split(translate(text, ',.', '  '), ' ')) AS word FROM documents)"
PERSON = "person AS (SELECT o_custkey AS person_id, min(o_orderdate) AS person_time FROM orders GROUP BY o_custkey)"
LOCAL = "CAST(substr(o_orderpriority, 1, 1) AS INT) % 2 <> 0 AND length(c_mktsegment) > 0 AND ascii(c_mktsegment) % 2 = 0"
SLIDING = "win AS (SELECT ts, user_id, date_trunc('hour', ts) - INTERVAL 1 HOUR * h AS window_start FROM events, range(10) r(h))"


@query("SELECT l_orderkey AS auction_id, l_linenumber AS bid_no, l_suppkey AS bidder_id, l_extendedprice AS amount, l_shipdate AS bid_time FROM lineitem WHERE l_orderkey % 2 <> 0")
def selection(spark, d):
    return jobs.selection(tables.bids(spark, d))


@query("SELECT l_orderkey AS key, strftime(l_shipdate, '%Y%m%d%H%M%S') || '$' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '$1' AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 2 <> 0")
def output_records(spark, d):
    sold = joins.join_on(jobs.selection(tables.bids(spark, d)), tables.auctions(spark, d), "auction_id", "id")
    return output_record(sold, "auction_id", "bid_time", F.col("start_time"))


@query("SELECT o_orderkey AS id, o_custkey AS seller_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS category_id, o_orderdate AS start_time, o_orderdate + INTERVAL 60 DAYS AS end_time, c_custkey AS person_id, c_name AS name, c_mktsegment AS province FROM orders JOIN customer ON o_custkey = c_custkey WHERE CAST(substr(o_orderpriority, 1, 1) AS INT) % 2 <> 0 AND length(c_mktsegment) > 0 AND ascii(c_mktsegment) % 2 = 0")
def local_item(spark, d):
    return jobs.local_item(tables.auctions(spark, d), tables.people(spark, d))


def _compact(time: str) -> str:
    return f"strftime({time}, '%Y%m%d%H%M%S') || rtrim(substr(strftime({time}, '%f'), 1, 5), '0')"


@query(f"WITH {PERSON} SELECT o_orderkey AS id, o_custkey AS seller_id, o_orderdate AS start_time, person_time, greatest(o_orderdate, person_time) AS event_time FROM orders JOIN customer ON o_custkey = c_custkey JOIN person ON person.person_id = o_custkey WHERE {LOCAL}")
def local_item_events(spark, d):
    return jobs.local_item_events(tables.auctions(spark, d), tables.people_events(spark, d)).select("id", "seller_id", "start_time", "person_time", "event_time")


@query(f"WITH {PERSON} SELECT o_orderkey AS key, {_compact('greatest(o_orderdate, person_time)')} || '$' || {_compact('(o_orderdate + INTERVAL 60 DAYS)')} || '$1' AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN person ON person.person_id = o_custkey WHERE {LOCAL}")
def local_item_records(spark, d):
    found = jobs.local_item_events(tables.auctions(spark, d), tables.people_events(spark, d))
    return output_record(found, "id", "event_time", F.col("end_time"))


@query(f"WITH {WORDS} SELECT doc_id, word, 1 AS count FROM w WHERE word <> ''")
def projection_words(spark, d):
    return jobs.projection(tables.read(spark, d, "documents"), "text", "doc_id")


@query(f"WITH {WORDS} SELECT word, count(*)::BIGINT AS total FROM w WHERE word <> '' GROUP BY word")
def wordcount_total(spark, d):
    return jobs.word_totals(jobs.projection(tables.read(spark, d, "documents"), "text"))


@query(f"WITH {WORDS} SELECT word || '=' || count(*)::VARCHAR AS line FROM w WHERE word <> '' GROUP BY word")
def word_report(spark, d):
    return jobs.word_report(wordcount_total(spark, d))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type AS word, count(*)::BIGINT AS total, max(ts) AS max_ts, count(*)::BIGINT AS n FROM events GROUP BY ALL HAVING count(*) <> 0")
def wordcount_tumbling(spark, d):
    words = tables.events(spark, d).select("ts", F.col("event_type").alias("word"), F.lit(1).alias("count"))
    return jobs.word_count(words, "word", "count", "ts", "1 day")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, user_id, count(*)::BIGINT AS n, max(ts) AS max_ts FROM events GROUP BY ALL")
def tumbling_count(spark, d):
    return aggregates.count_by_window(tables.events(spark, d), ["user_id"], "ts", "1 day")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*)::BIGINT AS n, max(ts) AS max_ts FROM events GROUP BY ALL")
def tumbling_total(spark, d):
    return aggregates.count_by_window(tables.events(spark, d), [], "ts", "1 day")


@query("WITH f AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, avg(value) + 2 * stddev_samp(value) AS most FROM events GROUP BY ALL) SELECT f.window_start, event_id, events.event_type, value FROM events JOIN f ON f.event_type = events.event_type AND f.window_start = time_bucket(INTERVAL 1 DAY, ts) WHERE value > most")
def window_outliers(spark, d):
    return aggregates.rows_above(tables.events(spark, d), ["event_type"], "value", "ts", "1 day").select("window_start", "event_id", "event_type", "value")


#: User aggregates of windows of events: the aggregate, its keys beside the window, and the window's size.
WINDOW_AGGREGATES = {
    "window_top_rows": (combine.TopRows("value", "event_id", 3), ["event_type"], "1 day"),
    "window_sessions": (combine.Sessions("ts", 1800), ["event_type"], "1 day"),
}
#: Tallies of such windows, likewise.
WINDOW_TALLIES = {
    "window_longest_gap": (tallies.LongestGaps("ts", 3600), ["user_id"], "7 days"),
    "window_quantiles": (tallies.Quantiles("value", (50, 90, 99)), ["event_type"], "1 day"),
}


def _placed(spark: SparkSession, d: str, size: str) -> DataFrame:
    return tables.events(spark, d).withColumn("window_start", aggregates.window_of("ts", size)["start"])


def _window_aggregate(spark: SparkSession, d: str, name: str) -> DataFrame:
    aggregate, keys, size = WINDOW_AGGREGATES[name]
    return combine.combined(_placed(spark, d, size), ["window_start", *keys], aggregate)


def _window_tally(spark: SparkSession, d: str, name: str) -> DataFrame:
    tally, keys, size = WINDOW_TALLIES[name]
    return tallies.tallied(_placed(spark, d, size), ["window_start", *keys], tally)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, (row_number() OVER w)::INT AS place, event_id, value FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type, time_bucket(INTERVAL 1 DAY, ts) ORDER BY value DESC, event_id) QUALIFY place <= 3")
def window_top_rows(spark, d):
    return _window_aggregate(spark, d, "window_top_rows")


@query(
    "WITH e AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, ts, event_id FROM events), "
    "b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS begins FROM e WINDOW w AS (PARTITION BY window_start, event_type ORDER BY ts, event_id)), "
    "s AS (SELECT *, (sum(begins) OVER (PARTITION BY window_start, event_type ORDER BY ts, event_id))::INT AS session FROM b) "
    "SELECT window_start, event_type, session, min(ts) AS first_ts, max(ts) AS last_ts, count(*)::BIGINT AS n FROM s GROUP BY ALL"
)
def window_sessions(spark, d):
    return _window_aggregate(spark, d, "window_sessions")


@query(
    "WITH g AS (SELECT time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01') AS window_start, user_id, lag(ts) OVER (PARTITION BY user_id, time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01') ORDER BY ts) AS gap_start, ts FROM events) "
    "SELECT window_start, user_id, gap_start, (epoch_us(ts) - epoch_us(gap_start)) / 1e6::DOUBLE AS gap_seconds FROM g WHERE ts - gap_start >= INTERVAL 1 HOUR QUALIFY row_number() OVER (PARTITION BY window_start, user_id ORDER BY gap_seconds DESC, gap_start) = 1"
)
def window_longest_gap(spark, d):
    return _window_tally(spark, d, "window_longest_gap")


@query("WITH q AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, quantile_disc(value, [0.5, 0.9, 0.99]) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL) SELECT window_start, event_type, unnest([50::DOUBLE, 90::DOUBLE, 99::DOUBLE]) AS percent, unnest(v) AS value FROM q")
def window_quantiles(spark, d):
    """Exact percentiles, from counts of values (``combine.Quantiles`` is the approximate sketch)."""
    return _window_tally(spark, d, "window_quantiles")


@query(f"WITH {SLIDING} SELECT window_start, user_id, count(*)::BIGINT AS n, max(ts) AS max_ts FROM win GROUP BY ALL")
def sliding_count(spark, d):
    return aggregates.count_by_window(tables.events(spark, d), ["user_id"], "ts", "10 hours", "1 hour")


@query(f"WITH {SLIDING}, c AS (SELECT window_start, user_id, count(*)::BIGINT AS n FROM win GROUP BY ALL) SELECT window_start, user_id, n FROM c QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY n DESC, user_id) = 1")
def hot_item(spark, d):
    return jobs.hot_item(tables.events(spark, d), "user_id", "ts", "10 hours", "1 hour")


@query(f"WITH {SLIDING}, c AS (SELECT window_start, user_id, count(*)::BIGINT AS n, max(ts) AS max_ts FROM win GROUP BY ALL), top AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY n DESC, user_id) = 1) SELECT user_id AS key, {_compact('max_ts')} || '$' || {_compact('(window_start + INTERVAL 10 HOURS)')} || '$' || n AS value FROM top")
def hot_item_records(spark, d):
    counts = aggregates.count_by_window(tables.events(spark, d), ["user_id"], "ts", "10 hours", "1 hour")
    top = filters.leader(counts, ["window_start"], "n", "user_id", "max_ts")
    return output_record(top, "user_id", "max_ts", F.col("window_start") + F.expr("INTERVAL 10 HOURS"), F.col("n"))


@query(f"WITH {SOLD} SELECT auction_id, bid_no, seller_id, amount, bid_time FROM sold")
def bid_auction_join(spark, d):
    return jobs.bids_in_time(tables.bids(spark, d), tables.auctions(spark, d)).select("auction_id", "bid_no", "seller_id", "amount", "bid_time")


@query(f"WITH {SOLD} SELECT auction_id, bid_no, amount, seller_id, bid_time FROM sold QUALIFY row_number() OVER (PARTITION BY auction_id ORDER BY amount DESC, bid_no, bid_time, seller_id) = 1")
def highest_bid(spark, d):
    return jobs.selling_prices(jobs.bids_in_time(tables.bids(spark, d), tables.auctions(spark, d)))


@query("SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events GROUP BY user_id")
def highest_bid_row(spark, d):
    return aggregates.highest(tables.events(spark, d), "user_id", "value", "event_id")


@query(f"WITH {PRICES} SELECT seller_id, round(sum(CAST(round(amount * 100) AS BIGINT))::BIGINT / 100 / count(*), 4) AS avg_amount, count(*)::BIGINT AS n, max(bid_time) AS max_ts FROM price GROUP BY seller_id")
def avg_price_by_seller(spark, d):
    return jobs.average_selling_price(tables.bids(spark, d), tables.auctions(spark, d))


@query(f"WITH {PRICES} SELECT seller_id AS key, {_compact('max(bid_time)')} || '$' || {_compact('(max(bid_time) + INTERVAL 1 DAY)')} || '$' || count(*) AS value FROM price GROUP BY seller_id")
def avg_price_records(spark, d):
    found = avg_price_by_seller(spark, d)
    return output_record(found, "seller_id", "max_ts", F.col("max_ts") + F.expr("INTERVAL 1 DAY"), F.col("n"))


@query(
    f"WITH {SOLD}, win AS (SELECT *, time_bucket(INTERVAL 5 DAYS, bid_time, TIMESTAMP '1970-01-01') - INTERVAL 5 DAYS * h AS sliding FROM sold, range(3) r(h)), "
    "price AS (SELECT sliding, auction_id, max(amount) AS amount, max(seller_id) AS seller_id, max(bid_time) AS bid_time FROM win GROUP BY ALL) "
    "SELECT time_bucket(INTERVAL 5 DAYS, bid_time, TIMESTAMP '1970-01-01') AS window_start, seller_id, round(sum(CAST(round(amount * 100) AS BIGINT))::BIGINT / 100 / count(*), 4) AS avg_amount, count(*)::BIGINT AS n, max(bid_time) AS max_ts FROM price GROUP BY ALL"
)
def windowed_avg_price(spark, d):
    sold = jobs.bids_in_time(tables.bids(spark, d), tables.auctions(spark, d))
    return jobs.windowed_average_price(sold, "15 days", "5 days", "5 days")


@query("SELECT user_id, ts, event_id, round(sum(CAST(round(value * 100) AS BIGINT)) OVER w::BIGINT / 100 / count(*) OVER w, 6) AS running_avg FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)".replace("OVER w::BIGINT / 100 / count(*) OVER w, 6)", "OVER w / 100 / count(*) OVER w, 6)"))
def running_avg(spark, d):
    return maps.running_average(tables.events(spark, d), "user_id", "value", ["ts", "event_id"]).select("user_id", "ts", "event_id", "running_avg")


@query("SELECT event_id, ts, user_id, event_type FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def distinct_by_key(spark, d):
    return filters.first_by_key(tables.events(spark, d).select("event_id", "ts", "user_id", "event_type"), "user_id", ["ts", "event_id"])


@query("SELECT event_id, user_id, (abs(user_id) % 4)::INT AS shard FROM events")
def modulo_partition(spark, d):
    return tables.events(spark, d).select("event_id", "user_id", exchange.shard_of(F.col("user_id"), 4).alias("shard"))


@query("SELECT event_id, user_id, s.shard::INT AS shard FROM events, range(4) s(shard)")
def broadcast_partition(spark, d):
    return exchange.to_all_shards(tables.events(spark, d).select("event_id", "user_id"), 4)


@query("SELECT event_id, unnest(CASE WHEN user_id IS NULL THEN [0, 1, 2, 3] ELSE [(abs(user_id) % 4)::INT] END) AS shard FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS user_id FROM events)")
def keyed_placement(spark, d):
    keyed = tables.events(spark, d).select("event_id", F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"))
    return exchange.place(keyed, "user_id", 4).drop("user_id")


@query("SELECT event_id, user_id, 1 AS via FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, user_id, 2 AS via FROM events WHERE event_type = 'view'")
def union_fan_in(spark, d):
    of = lambda kind, via: tables.events(spark, d).filter(F.col("event_type") == kind).select("event_id", "user_id", F.lit(via).alias("via"))
    return exchange.fan_in(of("click", 1), of("view", 2))


@query("SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts - INTERVAL 30 MINUTES AND a.ts + INTERVAL 30 MINUTES")
def near_in_time(spark, d):
    e = tables.events(spark, d)
    side = lambda kind, s: e.filter(F.col("event_type") == kind).select(F.col("event_id").alias(f"{s}_id"), F.col("user_id").alias(f"{s}_user"), F.col("ts").alias(f"{s}_ts"))
    return joins.join_near(side("click", "left"), side("purchase", "right"), "left_user", "right_user", "left_ts", "right_ts", 1800).select("left_id", "right_id")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON abs(CAST(floor(c_acctbal) AS BIGINT) - CAST(floor(s_acctbal) AS BIGINT)) <= 20")
def theta_band_join(spark, d):
    left = tables.read(spark, d, "customer").select("c_custkey", F.floor("c_acctbal").alias("c_value"))
    right = tables.read(spark, d, "supplier").select("s_suppkey", F.floor("s_acctbal").alias("s_value"))
    return joins.band_join(left, right, "c_value", "s_value", 20).select("c_custkey", "s_suppkey")


@query(f"WITH {EDGES}, two AS (SELECT from_id, to_id, 1 AS hops FROM edge UNION ALL SELECT a.from_id, b.to_id, 2 FROM edge a JOIN edge b ON a.to_id = b.from_id) SELECT from_id, to_id, min(hops)::INT AS hops FROM two GROUP BY ALL")
def nhop_2(spark, d):
    return iterate.within_hops(tables.edges(spark, d), 2)


@query(f"WITH {EDGES}, one AS (SELECT from_id, to_id, 1 AS hops FROM edge), two AS (SELECT * FROM one UNION ALL SELECT a.from_id, b.to_id, 2 FROM edge a JOIN edge b ON a.to_id = b.from_id), three AS (SELECT * FROM two UNION ALL SELECT a.from_id, b.to_id, a.hops + 1 FROM two a JOIN edge b ON a.to_id = b.from_id WHERE a.hops = 2) SELECT from_id, to_id, min(hops)::INT AS hops FROM three GROUP BY ALL")
def nhop_3(spark, d):
    return iterate.within_hops(tables.edges(spark, d), 3)


_RANK = "r{k} AS (SELECT page.page_id, 0.15 / (SELECT count(*) FROM page) + 0.85 * coalesce(s.share, 0) AS rank FROM page LEFT JOIN (SELECT to_id AS page_id, sum(rank / degree) AS share FROM edge JOIN deg USING (from_id) JOIN r{j} ON r{j}.page_id = edge.from_id GROUP BY to_id) s USING (page_id))"


@query(
    f"WITH {EDGES}, page AS (SELECT from_id AS page_id FROM edge UNION SELECT to_id FROM edge), deg AS (SELECT from_id, count(*) AS degree FROM edge GROUP BY from_id), r0 AS (SELECT page_id, 1.0::DOUBLE / (SELECT count(*) FROM page) AS rank FROM page), "
    + ", ".join(_RANK.replace("{k}", str(k)).replace("{j}", str(k - 1)) for k in (1, 2, 3))
    + " SELECT page_id, round(rank, 9) AS rank FROM r3"
)
def pagerank_3(spark, d):
    return iterate.page_rank(tables.edges(spark, d), 3).select("page_id", F.round("rank", 9).alias("rank"))


@query(
    f"WITH {EDGES}, page AS (SELECT from_id AS page_id FROM edge UNION SELECT to_id FROM edge), deg AS (SELECT from_id, count(*) AS degree FROM edge GROUP BY from_id), r0 AS (SELECT page_id, 1.0::DOUBLE / (SELECT count(*) FROM page) AS rank FROM page), "
    + ", ".join(_RANK.replace("AS (SELECT page.", "AS MATERIALIZED (SELECT page.").replace("{k}", str(k)).replace("{j}", str(k - 1)) for k in range(1, 7))
    + " SELECT r6.page_id, round(r6.rank, 9) AS rank FROM r6 JOIN r3 USING (page_id) WHERE abs(r6.rank - r3.rank) > 1e-5"
)
def pagerank_changes(spark, d):
    return jobs.rank_changes(tables.edges(spark, d), 3, 6, 1e-5).select("page_id", F.round("rank", 9).alias("rank"))


@query(
    f"WITH {EDGES}, page AS (SELECT from_id AS page_id FROM edge UNION SELECT to_id FROM edge), deg AS (SELECT from_id, count(*) AS degree FROM edge GROUP BY from_id), r0 AS (SELECT page_id, 1.0::DOUBLE / (SELECT count(*) FROM page) AS rank FROM page), "
    + ", ".join(_RANK.replace("AS (SELECT page.", "AS MATERIALIZED (SELECT page.").replace("{k}", str(k)).replace("{j}", str(k - 1)) for k in range(1, 7))
    + " SELECT page_id, round(rank, 8) AS rank FROM r6"
)
def pagerank_residual(spark, d):
    return iterate.page_rank_by_residual(tables.edges(spark, d), 6).select("page_id", F.round("rank", 8).alias("rank"))


@query(
    "WITH e AS (SELECT o_custkey AS page_id, o_orderkey AS arrival, (year(o_orderdate) - 1991)::INT AS epoch, o_totalprice AS value FROM orders), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY arrival) = 1 AS begins FROM e), "
    "n AS (SELECT *, max(CASE WHEN begins OR epoch <= 5 THEN epoch END) OVER w AS newest FROM f WINDOW w AS (PARTITION BY page_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "k AS (SELECT *, last_value(CASE WHEN begins OR (epoch <= 5 AND epoch > newest) THEN value END IGNORE NULLS) OVER w AS kept FROM n WINDOW w AS (PARTITION BY page_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) "
    "SELECT page_id, arrival, epoch, CASE WHEN begins OR epoch > newest THEN value ELSE kept END AS value FROM k WHERE begins OR (epoch <= 5 AND epoch >= newest)"
)
def epoch_collect(spark, d):
    """Orders as arrivals at their customers' pages, with the year as epoch, of which the fifth is the last."""
    arrivals = tables.read(spark, d, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("arrival"), (F.year("o_orderdate") - 1991).alias("epoch"), F.col("o_totalprice").alias("value"))
    return filters.newest_epoch(arrivals, "page_id", "epoch", ["arrival"], ["value"], 5)


@query(f"WITH RECURSIVE {EDGES}, reach AS (SELECT from_id, to_id FROM edge UNION SELECT reach.from_id, edge.to_id FROM reach JOIN edge ON reach.to_id = edge.from_id) SELECT from_id, to_id FROM reach")
def reachability(spark, d):
    """All pairs, from the classes and their closure: as many rows as pairs, which are given out where they are found."""
    return reach.pairs(tables.edges(spark, d))


REACH = f"{EDGES}, reach AS (SELECT from_id, to_id FROM edge UNION SELECT reach.from_id, edge.to_id FROM reach JOIN edge ON reach.to_id = edge.from_id), vertex AS (SELECT from_id AS vertex FROM edge UNION SELECT to_id FROM edge), class AS (SELECT vertex, least(vertex, coalesce(min(b.from_id), vertex)) AS component FROM vertex LEFT JOIN reach a ON a.from_id = vertex LEFT JOIN reach b ON b.from_id = a.to_id AND b.to_id = vertex GROUP BY vertex)"


@query(f"WITH RECURSIVE {REACH} SELECT vertex, component FROM class")
def reachability_classes(spark, d):
    """The class of each vertex: vertices of one class reach each other."""
    return reach.components(tables.edges(spark, d))


@query(f"WITH RECURSIVE {REACH} SELECT f.component, count(DISTINCT t.component)::BIGINT AS reaches FROM reach JOIN class f ON f.vertex = from_id JOIN class t ON t.vertex = to_id GROUP BY f.component")
def reachability_closure(spark, d):
    """How many classes each class reaches, counted in the closure's bits."""
    edges = tables.edges(spark, d)
    closed = reach.closure(edges, reach.components(edges))
    return closed.groupBy("component").agg(F.sum(F.bit_count("bits")).cast("long").alias("reaches"))


@query(f"WITH {EDGES} SELECT from_id AS page_id, to_id FROM edge")
def page_expand(spark, d):
    lists = adjacency_from_edges(tables.edges(spark, d), spark)
    return maps.unpack(lists, "neighbours", "to_id", "page_id")


@query(f"WITH {EDGES} SELECT from_id AS page_id, count(*)::INT AS degree, min(to_id) AS first_id FROM edge GROUP BY from_id")
def adjacency_lists(spark, d):
    return adjacency_from_edges(tables.edges(spark, d), spark).select("page_id", F.size("neighbours").alias("degree"), F.get("neighbours", F.lit(0)).alias("first_id"))


_QUANTILES = ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (90, 95, 99))


@query(f"SELECT event_type, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, {_QUANTILES}, round(stddev_samp(value), 4) AS std FROM events GROUP BY event_type")
def latency_summary(spark, d):
    return metrics.summary(tables.events(spark, d), ["event_type"], "value")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bin_start, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def throughput_bins(spark, d):
    return metrics.throughput(tables.events(spark, d), "ts", "1 hour")


@query("SELECT user_id % 7 AS partition, time_bucket(INTERVAL 1 HOUR, ts) AS bin_start, arg_min(value, (ts, event_id)) AS latency_ms FROM events GROUP BY ALL")
def latency_first_per_bin(spark, d):
    records = tables.events(spark, d).select((F.col("user_id") % 7).alias("partition"), "ts", "event_id", F.col("value").alias("latency_ms"))
    return metrics.first_per_bin(records, "partition", "ts", "event_id", "1 hour")


@query(
    "WITH r AS (SELECT user_id % 7 AS partition, ts, event_id, value AS latency_ms FROM events), "
    "span AS (SELECT partition, ceil(epoch_us(min(ts)) / 600e6)::BIGINT AS lo, floor((epoch_us(max(ts)) - 5000000) / 600e6)::BIGINT AS hi FROM r GROUP BY partition), "
    "t AS (SELECT partition, make_timestamp(n * 600000000) AS tick FROM (SELECT partition, unnest(range(lo, hi + 1)) AS n FROM span)), "
    "o AS (SELECT partition, ts, arg_min(latency_ms, event_id) AS latency_ms FROM r GROUP BY ALL) "
    "SELECT t.partition, tick, CASE WHEN latency_ms > 0 THEN latency_ms END AS latency_ms FROM t ASOF LEFT JOIN o ON t.partition = o.partition AND t.tick <= o.ts"
)
def latency_sampled(spark, d):
    """At every tenth minute the latency of the next record of each partition."""
    records = tables.events(spark, d).select((F.col("user_id") % 7).alias("partition"), "ts", "event_id", F.col("value").alias("latency_ms"))
    return metrics.sampled_latency(records, "partition", "ts", "event_id", 600_000, 5000, 86_400)


@query("SELECT event_id, event_type, user_id, round(coalesce(0.25 * lag(value) OVER w + 0.5 * value + 0.25 * lead(value) OVER w, value), 6) AS smooth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lowpass(spark, d):
    smooth = low_pass(tables.events(spark, d), "user_id", "value", ["ts", "event_id"])
    return smooth.select("event_id", "event_type", "user_id", F.round("smooth", 6).alias("smooth"))


_SAVGOL = " + ".join(f"{c!r} * lag(value, {-k}) OVER w" if k < 0 else f"{c!r} * value" if k == 0 else f"{c!r} * lead(value, {k}) OVER w" for k, c in zip(range(-9, 10), savgol_weights(19, 2)))


@query(f"SELECT event_id, user_id, round(greatest(v, 0), 5) AS smooth FROM (SELECT event_id, user_id, {_SAVGOL} AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE v IS NOT NULL")
def savgol_smooth(spark, d):
    smooth = savgol(tables.events(spark, d), "user_id", "value", ["ts", "event_id"])
    return smooth.filter("smooth IS NOT NULL").select("event_id", "user_id", F.round("smooth", 5).alias("smooth"))


_EXTENDED = "list_concat([near[1] - abs(near[k + 1] - near[1]) for k in range(9 - before, 0, -1)], near, [near[-1] + abs(near[-1 - k] - near[-1]) for k in range(1, 10 - after)])"
_WEIGHTS = "[" + ", ".join(f"{c!r}::DOUBLE" for c in savgol_weights(19, 2)) + "]"


@query(
    "WITH f AS (SELECT event_id, user_id, value, list(value) OVER (w ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING) AS near, count(*) OVER (w ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS before, count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS after, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    f"x AS (SELECT *, {_EXTENDED} AS ext FROM f) "
    f"SELECT event_id, user_id, round(CASE WHEN n > 9 THEN greatest(list_sum([ext[k] * {_WEIGHTS}[k] for k in range(1, 20)]), 0) ELSE value END, 5) AS smooth FROM x"
)
def savgol_mirrored(spark, d):
    smooth = mirrored(tables.events(spark, d), "user_id", "value", ["ts", "event_id"])
    return smooth.select("event_id", "user_id", F.round("smooth", 5).alias("smooth"))


def _checkpoint_log(spark: SparkSession, d: str) -> DataFrame:
    """Events read as a log of checkpoints: runs by user, forced ones by kind, sizes by value."""
    return tables.events(spark, d).select(F.col("event_type").alias("protocol"), (F.col("user_id") % 5).alias("run"), (F.col("event_id") % 3 == 0).alias("forced"), (F.col("event_id") % 1000 + 100).cast("double").alias("taken_ms"), (F.col("event_id") * 977 % 1000003).alias("bytes"))


@query(
    "WITH l AS (SELECT event_type AS protocol, user_id % 5 AS run, event_id % 3 = 0 AS forced, (event_id % 1000 + 100)::DOUBLE AS taken_ms, event_id * 977 % 1000003 AS bytes FROM events), "
    "g AS (SELECT protocol, round(count(*) / count(DISTINCT run))::BIGINT AS total, round(count(*) FILTER (NOT forced) / count(DISTINCT run))::BIGINT AS regular, avg(round(bytes / 1000)) AS a, stddev_samp(round(bytes / 1000)) AS b, avg(taken_ms) AS c, stddev_samp(taken_ms) AS e FROM l GROUP BY protocol) "
    "SELECT protocol, total, regular, total - regular AS forced, round(a)::BIGINT AS kb_mean, round(b)::BIGINT AS kb_std, round(c)::BIGINT AS ms_mean, round(e)::BIGINT AS ms_std FROM g"
)
def checkpoint_summary(spark, d):
    return metrics.checkpoint_summary(_checkpoint_log(spark, d), ["protocol"], "run")


@query("SELECT event_type AS protocol, count(*)::BIGINT AS recovered, round(avg((event_id % 1000)::DOUBLE), 3) AS restore_ms, round(avg((event_id % 977) / 1000), 3) AS rollback_s FROM events GROUP BY event_type")
def recovery_summary(spark, d):
    log = tables.events(spark, d).select(F.col("event_type").alias("protocol"), (F.col("event_id") % 1000).cast("double").alias("restored_ms"), (F.col("event_id") % 977).cast("double").alias("rollback_ms"))
    return metrics.recovery_summary(log, ["protocol"])


def checkpoint_history(spark: SparkSession, d: str, instances: int = 6) -> DataFrame:
    """Events as checkpoints of instances in a line; each has seen the latest checkpoint of the one before it.

    Neighbours are paired in one sort: an instance's rows also stand in the next instance's history.
    """
    rows = tables.events(spark, d).select(F.col("event_id").cast("string").alias("id"), (F.col("user_id") % instances).alias("i"), "ts", "event_id")
    own = rows.select(F.col("i").alias("at"), "id", "ts", "event_id", F.lit(False).alias("seen"))
    left = rows.filter(F.col("i") < instances - 1).select((F.col("i") + 1).alias("at"), "id", "ts", "event_id", F.lit(True).alias("seen"))
    before = W.partitionBy("at").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    both = own.unionByName(left).withColumn("last", F.last(F.when(F.col("seen"), F.col("id")), ignorenulls=True).over(before)).filter("NOT seen")
    name = lambda i: F.concat(F.lit("instance"), i.cast("string"))
    needs = F.when(F.col("last").isNotNull(), F.create_map(name(F.col("at") - 1), F.col("last"))).otherwise(F.create_map().cast("map<string,string>"))
    return both.select("id", name(F.col("at")).alias("instance_name"), F.col("ts").alias("created_at"), needs.alias("dependencies"))


@query()
def recovery_line(spark, d):
    """The line of a row of instances from their whole history (a loop over small heads, hence no SQL)."""
    return recovery.recovery_line(checkpoint_history(spark, d))


@query("WITH c AS (SELECT 'instance' || (user_id % 6) AS instance_name, event_id::VARCHAR AS id, row_number() OVER (PARTITION BY user_id % 6 ORDER BY ts DESC, event_id::VARCHAR DESC) AS back FROM events) SELECT instance_name, max(id) FILTER (back = 1) AS last_id, max(id) FILTER (back = 2) AS previous_id FROM c GROUP BY instance_name")
def last_two_checkpoints(spark, d):
    return recovery.last_two(checkpoint_history(spark, d))


@query("SELECT event_id, user_id, event_type FROM events WHERE ('0x' || substr(md5(event_id::VARCHAR), 1, 7))::BIGINT % 5 = 0")
def sampler(spark, d):
    return filters.hash_sample(tables.events(spark, d), "event_id", 5).select("event_id", "user_id", "event_type")


def _register_streams() -> None:
    from .streaming import jobs as streams

    same = {
        "stream_running_avg": "running_avg", "stream_near_in_time": "near_in_time", "stream_tumbling_count": "tumbling_count", "stream_word_totals": "wordcount_total",
        "stream_local_item": "local_item", "stream_hot_item": "hot_item", "stream_avg_price": "avg_price_by_seller", "stream_distinct_by_key": "distinct_by_key",
        "stream_local_item_events": "local_item_events", "stream_windowed_avg_price": "windowed_avg_price",
    }
    for name, (aggregate, keys, size) in WINDOW_AGGREGATES.items():
        QUERIES[f"stream_{name}"] = partial(streams.stream_window_aggregate, aggregate=aggregate, keys=keys, size=size)
        SQL[f"stream_{name}"] = SQL[name]
    for name, (tally, keys, size) in WINDOW_TALLIES.items():
        QUERIES[f"stream_{name}"] = partial(streams.stream_window_tally, tally=tally, keys=keys, size=size)
        SQL[f"stream_{name}"] = SQL[name]
    for name in (*same, "stream_selection", "stream_nhop", "stream_echo"):
        QUERIES[name] = getattr(streams, name)
    SQL.update({stream: SQL[batch] for stream, batch in same.items()})
    SQL["stream_selection"] = "SELECT l_orderkey AS auction_id, l_linenumber AS bid_no, l_extendedprice AS amount FROM lineitem WHERE l_orderkey % 2 <> 0"
    SQL["stream_echo"] = "SELECT doc_id, text FROM documents"
    SQL["stream_nhop"] = (
        "WITH e AS (SELECT DISTINCT user_id AS from_id, event_id // 20 AS to_id FROM events), "
        "p AS (SELECT from_id, to_id, 1 AS hops FROM e UNION ALL SELECT a.from_id, b.to_id, 2 FROM e a JOIN e b ON a.to_id = b.from_id) "
        "SELECT from_id, to_id, min(hops)::INT AS hops FROM p GROUP BY ALL"
    )


_register_streams()
