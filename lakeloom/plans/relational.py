"""Relational queries over the star schema and the event table, each with its SQL for DuckDB.

Written as plain DataFrame plans: scans with pushed-down filters and pruned columns, equi-joins whose strategy Spark picks by
size, aggregates with map-side partial results, and windows partitioned by high-cardinality keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-key aggregate of line items up to a date."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        _t(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz '2000-09-02'").groupBy("l_returnflag", "l_linestatus")
        .agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))
    )


def nation_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-table inner join and a sum."""
    items, orders, customers = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("l_extendedprice"), 2).alias("sales"), F.count("*").alias("n"))


def order_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left outer join: orders with the number of their items, 0 included."""
    orders, items = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    return orders.join(items, orders.o_orderkey == items.l_orderkey, "left").select("o_orderkey", F.coalesce("k", F.lit(0)).alias("n_items"))


def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer join of documents and labels."""
    d, t = _t(spark, sf_dir, "documents").select("doc_id", "lang"), _t(spark, sf_dir, "labels")
    return d.join(t, "doc_id", "full").groupBy("lang", "quality").agg(F.count("*").alias("n"))


def ordered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi join: orders that have a returned item."""
    items = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    orders = _t(spark, sf_dir, "orders")
    return orders.join(items, orders.o_orderkey == items.l_orderkey, "left_semi").select("o_orderkey", "o_orderstatus")


def empty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti join: orders without items."""
    orders, items = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    return orders.join(items, orders.o_orderkey == items.l_orderkey, "left_anti").select("o_orderkey", "o_custkey")


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollup with grouping marks."""
    rolled = _t(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority")
    return rolled.agg(F.count("*").alias("n"), (F.grouping("o_orderstatus") + F.grouping("o_orderpriority")).cast("long").alias("level"))


def flag_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def distinct_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct and filtered aggregates."""
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("discounted"))


def customer_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking functions in a partition."""
    w = W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.dense_rank().over(w).cast("long").alias("dr"), F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"))


def running_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows frame: sum over an event and the three before it."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    return _t(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("last_four"))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k with a unique tie-break."""
    return _t(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


def shared_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersect: nations with both customers and suppliers."""
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(_t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


def unmatched_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Except all: customer nations less supplier nations, repeats counted."""
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).exceptAll(_t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


def last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: each event with its user's last view before or at it, by one window instead of a range join."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return _t(spark, sf_dir, "events").select("event_id", "event_type", seen.alias("view_id")).filter("event_type != 'view' and view_id is not null")


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling one-day windows."""
    days = _t(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return days.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows with a gap of twelve hours."""
    s = _t(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON text."""
    return _t(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


def brand_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivot of line status by return flag."""
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count("l_returnflag"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents by language, pre-aggregated before the shuffle."""
    words = _t(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "[ \\n\\t\\r]+")).alias("word"))
    return words.filter("word != ''").groupBy("lang", "word").agg(F.count("*").alias("n"))


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's answer: an equi-join on the next turn."""
    t = _t(spark, sf_dir, "conversations")
    u = t.filter("role = 'user'").select("conv_id", F.col("turn").alias("at"), (F.col("turn") + 1).alias("turn"))
    return u.join(t.filter("role = 'assistant'").select("conv_id", "turn", F.length("text").cast("long").alias("answer_chars")), ["conv_id", "turn"]).select("conv_id", "at", "answer_chars")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text for each conversation, turns in order."""
    t = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return t.select("conv_id", F.md5(F.array_join(F.transform("x", lambda r: F.concat(r["role"], F.lit(": "), r["text"])), "\n").cast("binary")).alias("digest"))


QUERIES = {f.__name__: f for f in (
    pricing_summary, nation_sales, order_sizes, label_coverage, ordered_items, empty_orders, status_rollup, flag_cube, distinct_parts, customer_ranks, running_values, top_orders,
    shared_nations, unmatched_customers, last_view, daily_events, user_sessions, event_props, brand_pivot, word_counts, page_hosts, turn_pairs, transcripts,
)}

ORACLE = {
    "pricing_summary": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL
""",
    "nation_sales": "SELECT n_name, round(sum(l_extendedprice), 2) AS sales, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "order_sizes": "SELECT o_orderkey, count(l_orderkey) AS n_items FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "label_coverage": "SELECT lang, quality, count(*) AS n FROM documents FULL JOIN labels USING (doc_id) GROUP BY ALL",
    "ordered_items": "SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "empty_orders": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "status_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) + grouping(o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "flag_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "distinct_parts": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM lineitem GROUP BY l_returnflag",
    "customer_ranks": """
SELECT o_orderkey, row_number() OVER w AS rn, dense_rank() OVER w AS dr, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)
""",
    "running_values": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS last_four FROM events",
    "top_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "shared_nations": "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "unmatched_customers": "SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "last_view": """
SELECT e.event_id, e.event_type, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type <> 'view') e
ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts
""",
    "daily_events": "SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "user_sessions": """
WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM b)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k
""",
    "event_props": "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL",
    "brand_pivot": "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag",
    "word_counts": r"SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array(text, '[ \n\t\r]+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL",
    "page_hosts": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages",
    "turn_pairs": "SELECT u.conv_id, u.turn AS at, length(a.text)::BIGINT AS answer_chars FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'",
    "transcripts": "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
}
