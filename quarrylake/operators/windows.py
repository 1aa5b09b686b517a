"""Ordered-sequence, top-k and packing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.query import Query, sql_query, table
from . import asof, overlap


def wn01_throttle(spark: SparkSession, sf: str) -> DataFrame:
    """Events accepted at a distance of more than six hours from the last accepted one of their session and kind."""
    events = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return asof.throttle(events, ["user_id", "event_type"], "ts", "event_id", 6 * 3600).select("event_id")


#: The fold as a recursion from one accepted event to the next.
WN01 = """
    WITH RECURSIVE e AS (SELECT user_id, event_type, ts, event_id FROM events),
    a AS (
        SELECT user_id, event_type, min((ts, event_id)) AS x FROM e GROUP BY ALL
        UNION ALL
        SELECT a.user_id, a.event_type, (SELECT min((e.ts, e.event_id)) FROM e WHERE e.user_id = a.user_id AND e.event_type = a.event_type AND e.ts > a.x[1] + INTERVAL '6 hours')
        FROM a WHERE a.x IS NOT NULL)
    SELECT x[2] AS event_id FROM a WHERE x IS NOT NULL
"""


def wn02_dedup_key(spark: SparkSession, sf: str) -> DataFrame:
    """Key of a prompt: session, the last turn end before it, and a digest of its wording."""
    events = table(spark, sf, "events")
    last = asof.nearest(events, "user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")), "last_end")
    key = F.concat_ws("|", F.col("user_id").cast("string"), F.coalesce(F.col("last_end").cast("string"), F.lit("-")), F.substring(F.sha2(F.lower(F.trim("props")), 256), 1, 16))
    return last.filter("event_type = 'view'").select("event_id", key.alias("dedup_key"))


WN02 = """
    SELECT event_id, concat_ws('|', user_id::VARCHAR, coalesce(last_end::VARCHAR, '-'), substr(sha256(lower(trim(props))), 1, 16)) AS dedup_key
    FROM (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_end FROM events)
    WHERE event_type = 'view'
"""


def wn11_budget_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order by price, packed into a budget of 80 units; what does not fit is passed over."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"), F.col("l_quantity").cast("long").alias("cost"))
    lines = lines.withColumn("rank", -F.col("price"))
    packed = asof.pack_budget(lines, "l_orderkey", ["rank", "l_linenumber", "l_partkey", "l_suppkey"], "cost", 80)
    return packed.groupBy("l_orderkey").agg(F.sum(F.when(F.col("taken"), F.col("cost")).otherwise(0)).alias("used"), F.count(F.when(F.col("taken"), 1)).alias("taken"))


WN11 = """
    WITH r AS (SELECT l_orderkey, l_quantity::BIGINT AS cost, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
    f AS (SELECT l_orderkey, list_reduce(list_prepend({'used': 0::BIGINT, 'taken': 0::BIGINT}, list({'used': cost, 'taken': 1::BIGINT} ORDER BY n)),
        lambda a, x: CASE WHEN a.used + x.used <= 80 THEN {'used': a.used + x.used, 'taken': a.taken + 1} ELSE a END) AS s FROM r GROUP BY l_orderkey)
    SELECT l_orderkey, s.used AS used, s.taken AS taken FROM f
"""


def query_coverage(spark: SparkSession, sf: str, least: float) -> DataFrame:
    """(item_id, doc_id, coverage): the share of a query's token weight that a document has, from ``least`` up; unknown tokens weigh most."""
    docs, asked = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    found = overlap.covering(docs.select(F.col("doc_id").alias("id"), "text"), asked.select(F.col("item_id").alias("id"), "text"), least)
    return found.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), F.round(F.col("inter") / F.col("total"), 5).alias("coverage"))


def so02_recall_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage of a query by each document plus a bonus for young ones; the five best per query."""
    scored = query_coverage(spark, sf, 0.3)
    age = F.col("doc_id") % 90
    ranked = scored.withColumn("score", F.round(F.col("coverage") + 0.1 * F.exp(-age / 30), 5))
    from pyspark.sql import Window

    best = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return ranked.withColumn("place", best).filter("place <= 5").select("item_id", "doc_id", "coverage", "place")


SO02 = f"""
    WITH d AS (SELECT DISTINCT doc_id, tok FROM (SELECT doc_id, unnest({T.DUCK_TOKENS.format(c='text')}) AS tok FROM documents)),
    q AS (SELECT DISTINCT item_id, tok FROM (SELECT item_id, unnest({T.DUCK_TOKENS.format(c='text')}) AS tok FROM benchmark)),
    n AS (SELECT greatest(1, count(*)) AS n FROM documents),
    f AS (SELECT tok, count(*) AS df FROM d GROUP BY tok),
    w AS (SELECT item_id, q.tok, ln(1 + n.n / coalesce(f.df, 0.5)) AS w FROM q CROSS JOIN n LEFT JOIN f ON q.tok = f.tok),
    t AS (SELECT item_id, sum(w) AS total FROM w GROUP BY item_id),
    h AS (SELECT item_id, doc_id, sum(w) AS hit FROM w JOIN d USING (tok) GROUP BY item_id, doc_id),
    c AS (SELECT item_id, doc_id, round(hit / total, 5) AS coverage FROM h JOIN t USING (item_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(coverage + 0.1 * exp(-(doc_id % 90) / 30), 5) DESC, doc_id) AS place FROM c WHERE coverage >= 0.3)
    SELECT item_id, doc_id, coverage, place FROM r WHERE place <= 5
"""

QUERIES = [
    Query("wn01_throttle", wn01_throttle, WN01),
    Query("wn02_dedup_key", wn02_dedup_key, WN02),
    Query("wn11_budget_packing", wn11_budget_packing, WN11),
    Query("so02_recall_rank", so02_recall_rank, SO02),
    sql_query("wn03_first_and_last_prompts", "SELECT user_id, event_id, first_place, last_place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_place, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS last_place FROM {events} WHERE event_type = 'view') WHERE first_place <= 3 OR last_place <= 3"),
    sql_query("wn06_newest_per_signature", "SELECT signature, max_by(event_id, struct(resolved, ts, event_id)) AS case_id FROM (SELECT concat(event_type, ':', props) AS signature, CASE WHEN value > 50 THEN 1 ELSE 0 END AS resolved, ts, event_id FROM {events}) GROUP BY signature", "SELECT concat(event_type, ':', props) AS signature, max_by(event_id, (CASE WHEN value > 50 THEN 1 ELSE 0 END, ts, event_id)) AS case_id FROM events GROUP BY signature"),
    sql_query("wn07_seniority", "SELECT s.o_orderkey AS younger, t.o_orderkey AS elder FROM (SELECT o_orderkey, o_orderdate, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS other FROM {orders}) s JOIN {orders} t ON s.other = t.o_orderkey WHERE t.o_orderdate < s.o_orderdate OR (t.o_orderdate = s.o_orderdate AND t.o_orderkey < s.o_orderkey)"),
    sql_query("wn09_latest_open", "SELECT o_custkey, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS latest FROM {orders} WHERE o_orderstatus = 'O' GROUP BY o_custkey", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey"),
    sql_query("wn10_core_priority", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = 'O' ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderdate DESC, o_orderkey LIMIT 40"),
    sql_query("wn12_recent_supersedes", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM {orders}) WHERE before >= o_orderdate - INTERVAL '7' DAY ORDER BY o_orderdate DESC, o_orderkey LIMIT 5"),
    sql_query("so04_neighbour_bonus", "SELECT l_orderkey, l_partkey, l_linenumber, round(score + CASE WHEN l_returnflag = 'A' THEN 0.2 ELSE 0 END, 6) AS final FROM (SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, l_discount * 5 AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_partkey, l_linenumber, l_suppkey) AS r FROM {lineitem}) WHERE r <= 6 AND score >= 0.15"),
]
