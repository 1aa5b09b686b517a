"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, tasks_for


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Every neighbour above a node is linked to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    return both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).filter("src <> dst").coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """A node and its neighbours below it are linked to the least of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("low"))
    own = least.select("src", F.col("low").alias("dst"))
    rest = down.join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return own.unionByName(rest).filter("src <> dst").coalesce(tasks).distinct().coalesce(tasks)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component.

    ``edges`` has src and dst.  Self loops and nulls are dropped.  Each round is cut off through the
    shared checkpoint folder; the number of rounds grows with the logarithm of the longest path.  A round has as many tasks as
    its edges are worth, since each task of each shuffle leaves files until the driver collects its garbage.
    """
    edges = checkpointed(edges.select("src", "dst").filter("src <> dst").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        tasks = tasks_for(edges.sparkSession, now[0])
        edges = checkpointed(_small_star(_large_star(edges.coalesce(tasks), tasks), tasks))
        before, now = now, state(edges)
        if before == now:
            break
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(roots)
