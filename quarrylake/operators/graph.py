"""Bounded graph walks over edge tables: closures, change impact, live heads, status derivation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import checkpointed
from ..plans.query import Query, sql_query, table

#: Orders of a customer form a chain: a newer order replaces the one before it.
CHAIN = "SELECT o_orderkey AS src, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM {orders}"
DUCK_CHAIN = CHAIN.replace("{orders}", "orders")


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, level) of everything within ``depth`` steps of the seeds; level is that of the first reach.

    ``edges`` has src and dst and is followed from src to dst.  Each step joins only the frontier, and
    what was seen before is dropped by an anti join.
    """
    seen = checkpointed(seeds.select("node").distinct().withColumn("level", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).filter("node is not null").distinct()
        frontier = checkpointed(step.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = checkpointed(seen.unionByName(frontier))
    return seen


def live_heads(edges: DataFrame, live: DataFrame) -> DataFrame:
    """(node, head): for each replaced node the live nodes that its replacements lead to.

    ``edges`` runs from a node to its replacements; ``live`` has node.  Steps are doubled each round, so
    everything within n steps is found in log n rounds; with as many rounds as the number of nodes asks
    for, what is still on its way then goes round in circles and gives no row, like chains without a live end.
    """
    alive = live.select(F.col("node").alias("head"), F.lit(True).alias("is_live"))
    hop = edges.select(F.col("src").alias("node"), F.col("dst").alias("head")).filter("node is not null and head is not null").distinct()
    hop = checkpointed(hop.join(alive, "head", "left").select("node", "head", F.coalesce("is_live", F.lit(False)).alias("done")))
    nodes = hop.select("node").distinct().count()
    for _ in range(max(1, nodes.bit_length())):
        on_way = hop.filter("not done")
        if on_way.isEmpty():
            break
        onward = hop.select(F.col("node").alias("at"), F.col("head").alias("next"), F.col("done").alias("next_done"))
        moved = on_way.join(onward, F.col("head") == F.col("at")).select("node", F.col("next").alias("head"), F.col("next_done").alias("done"))
        hop = checkpointed(hop.filter("done").unionByName(moved).distinct())
    return hop.filter("done").select("node", "head")


def chain(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(CHAIN, orders=table(spark, sf, "orders")).filter("dst is not null")


def gr06_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Everything within eight replacements before the costliest orders."""
    seeds = table(spark, sf, "orders").filter("o_totalprice > 490000").select(F.col("o_orderkey").alias("node"))
    return reach(chain(spark, sf), seeds, 8)


def gr17_change_impact(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that build on a changed one, by level of first reach (four levels)."""
    seeds = table(spark, sf, "orders").filter("o_totalprice < 10000").select(F.col("o_orderkey").alias("node"))
    incoming = chain(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(incoming, seeds, 4)


def gr26_live_heads(spark: SparkSession, sf: str) -> DataFrame:
    """The open order at which each replaced order's chain of replacements arrives."""
    orders = table(spark, sf, "orders")
    replaced = chain(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    live = orders.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("node"))
    return live_heads(replaced, live)


def walk_sql(edges: str, seeds: str, depth: int) -> str:
    return f"""
        WITH RECURSIVE e AS ({edges}), w AS (
            SELECT node, 0 AS level FROM ({seeds}) UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON e.src = w.node WHERE w.level < {depth} AND e.dst IS NOT NULL)
        SELECT node, min(level) AS level FROM w GROUP BY node
    """


QUERIES = [
    Query("gr06_include_closure", gr06_closure, walk_sql(DUCK_CHAIN, "SELECT o_orderkey AS node FROM orders WHERE o_totalprice > 490000", 8)),
    Query("gr17_change_impact", gr17_change_impact, walk_sql(f"SELECT dst AS src, src AS dst FROM ({DUCK_CHAIN})", "SELECT o_orderkey AS node FROM orders WHERE o_totalprice < 10000", 4)),
    Query("gr26_live_heads", gr26_live_heads, f"WITH RECURSIVE e AS (SELECT dst AS src, src AS dst FROM ({DUCK_CHAIN}) WHERE dst IS NOT NULL), w AS (SELECT src AS node, dst AS head FROM e UNION SELECT w.node, e.dst FROM w JOIN orders o ON o.o_orderkey = w.head AND o.o_orderstatus <> 'O' JOIN e ON e.src = w.head) SELECT w.node, w.head FROM w JOIN orders o ON o.o_orderkey = w.head AND o.o_orderstatus = 'O'"),
    sql_query("gr04_namespaced_index", "SELECT concat(p_brand, '::', p_name) AS qname, count(*) AS declarations, min(p_partkey) AS first FROM {part} GROUP BY concat(p_brand, '::', p_name)"),
]
