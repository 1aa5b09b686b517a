"""Budgeted context blocks, hand-over lines, work states and history targets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.query import Query, table


def pack_blocks(df: DataFrame, key: str, block: str, order: list[str], cost: str, budget: int, header: int) -> DataFrame:
    """Adds ``taken``: blocks of one key share a budget that shrinks from block to block.

    Inside a block lines are packed greedily, passing over what does not fit.  A block costs its header
    only if a line of it is taken.  Sorted rows are streamed; the state is the budget left.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", taken boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, left, room, opened = None, 0, 0, False
        for batch in batches:
            taken = []
            for k, b, c in zip(batch[key].tolist(), batch[block].tolist(), batch[cost].tolist(), strict=True):
                if at is None or k != at[0]:
                    left = budget
                    at = None
                if at is None or b != at[1]:
                    at, room, opened = (k, b), left - header, False
                ok = c <= room
                if ok:
                    room -= c
                    left -= c + (0 if opened else header)
                    opened = True
                taken.append(ok)
            yield batch.assign(taken=taken)

    return df.repartition(key).sortWithinPartitions(key, block, *order).mapInPandas(run, schema)


def ct03_session_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer in three blocks by status under one budget of 60; a block's header costs 5."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", F.length("o_orderpriority").cast("long").alias("cost"))
    return pack_blocks(orders, "o_custkey", "o_orderstatus", ["o_orderkey"], "cost", 60, 5).select("o_orderkey", "taken")


#: The same fold as a recursion over each customer's orders.
CT03 = """
    WITH RECURSIVE r AS (SELECT o_custkey AS k, o_orderstatus AS b, o_orderkey AS id, length(o_orderpriority)::BIGINT AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS n FROM orders),
    f AS (
        SELECT k, n, id, b, c <= 55 AS taken, CASE WHEN c <= 55 THEN 60 - c - 5 ELSE 60 END AS remaining, CASE WHEN c <= 55 THEN 55 - c ELSE 55 END AS room, c <= 55 AS opened FROM r WHERE n = 1
        UNION ALL
        SELECT k, n, id, b, c <= base, CASE WHEN c <= base THEN remaining - c - CASE WHEN was THEN 0 ELSE 5 END ELSE remaining END, CASE WHEN c <= base THEN base - c ELSE base END, was OR c <= base
        FROM (SELECT r.k, r.n, r.id, r.b, r.c, f.remaining, CASE WHEN r.b = f.b THEN f.room ELSE f.remaining - 5 END AS base, r.b = f.b AND f.opened AS was FROM f JOIN r ON r.k = f.k AND r.n = f.n + 1))
    SELECT id AS o_orderkey, taken FROM f
"""


QUERIES = [
    Query("ct03_session_blocks", ct03_session_blocks, CT03),
]
