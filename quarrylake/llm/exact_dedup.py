"""Exact de-duplication with a heavy-hitter split.

A Misra-Gries summary per partition finds digests that may cover a large share of the rows.  The
summed summaries leave a number of candidates that is bounded by the share alone; an exact count
verifies them, and the verified winners are broadcast, so rows of hot groups are decided on the map
side.  All other digests go through one ordinary shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, thrifty

#: A digest is hot when it holds at least 1/HOT_SHARE of the rows, so there are HOT_SHARE of them at most.
HOT_SHARE = 256
#: Bits of the map that keeps texts of single documents from being shuffled.
SLOTS = 1 << 24
#: Counters of one Misra-Gries summary; its estimates are short by rows / (COUNTERS + 1) at most.
COUNTERS = 4096


def shrink(summary: Counter, counters: int) -> Counter:
    """Misra-Gries step: subtract the (counters + 1)-th largest count and drop what reaches zero."""
    if len(summary) <= counters:
        return summary
    cut = sorted(summary.values(), reverse=True)[counters]
    return Counter({k: v - cut for k, v in summary.items() if v > cut})


def misra_gries(df: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """(key, est): lower bounds of the counts, from one mergeable summary per partition."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        summary: Counter = Counter()
        for batch in batches:
            summary.update(batch[key].tolist())
            summary = shrink(summary, counters)
        if summary:
            yield pd.DataFrame({key: list(summary.keys()), "est": list(summary.values())})

    parts = df.select(key).mapInPandas(thrifty(summarise), f"{key} string, est long")
    return parts.groupBy(key).agg(F.sum("est").alias("est"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: int = HOT_SHARE, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty.  Texts are equal when identical after lower-casing A-Z.  The row with
    the largest id stays; a null id sorts below every other id, and of repeated rows with the same id
    and text exactly one is kept.  An empty table gives no rows.
    """
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    base = checkpointed(df.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))).withColumn("_row", F.monotonically_increasing_id())
    total = base.count()
    floor = max(1.0, total / hot_share - total / (counters + 1))
    candidates = misra_gries(base, "text_sha256", counters).filter(F.col("est") >= F.lit(floor)).select("text_sha256")
    verified = (
        base.join(F.broadcast(candidates), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), F.col("doc_id"), F.col("_row")))["_row"].alias("_keep"), F.count("*").alias("group_size"))
        .filter(F.col("group_size") >= F.lit(max(2, -(-total // hot_share))))
    )
    winners = checkpointed(verified.repartition(1))  # at most hot_share rows
    split = base.join(F.broadcast(winners), "text_sha256", "left")
    hot = split.filter(F.col("group_size").isNotNull())
    decided = hot.withColumn("kept", F.col("_row") == F.col("_keep"))
    group = Window.partitionBy("text_sha256")
    rest = (
        split.filter(F.col("group_size").isNull())
        .withColumn("keep_id", F.max("doc_id").over(group))
        .withColumn("group_size", F.count("*").over(group))
        .withColumn("kept", F.row_number().over(group.orderBy(F.col("doc_id").desc_nulls_last())) == 1)
    )
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return decided.select(*columns).unionByName(rest.select(*columns))


def keep_first_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: int = HOT_SHARE) -> DataFrame:
    """The rows of ``df`` that exact_dedup keeps, with all their columns; nulls and ties as there.

    Rows of hot groups are decided on the map side.  Digests that occur once need no decision: a map of
    SLOTS bits, set for the digests of all other groups, lets their rows pass without a shuffle.  What
    it holds back, a few rows of single documents among it, is joined with the kept (id, digest) pairs.
    """
    names = df.columns
    decided = checkpointed(exact_dedup(df, id_col, text_col, hot_share).filter("group_size > 1"))
    total = df.count()
    hot = decided.filter((F.col("group_size") >= F.lit(max(2, -(-total // hot_share)))) & F.col("kept")).select(F.col("text_sha256").alias("_digest"), F.col("keep_id").alias("_keep"))
    slot = F.pmod(F.xxhash64("text_sha256"), F.lit(SLOTS)) + 1
    slots = decided.groupBy(F.bitmap_bucket_number(slot).alias("_at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits"))
    own = F.pmod(F.xxhash64("_digest"), F.lit(SLOTS)) + 1
    keyed = df.withColumn("_digest", F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    keyed = keyed.withColumn("_at", F.bitmap_bucket_number(own)).withColumn("_bit", F.bitmap_bit_position(own)).join(F.broadcast(slots), "_at", "left")  # SLOTS / 8 bytes
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    shared = F.coalesce(F.getbit(byte, F.pmod("_bit", F.lit(8)).cast("int")) == 1, F.lit(False))
    split = keyed.withColumn("_shared", shared).drop("_at", "_bit", "_bits").join(F.broadcast(hot), "_digest", "left")  # hot_share rows
    own_id = F.col(id_col)
    asked = split.filter(F.col("_shared") & (F.col("_keep").isNull() | own_id.eqNullSafe(F.col("_keep"))))
    kept = decided.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_kept"))
    grouped = decided.select(F.col("text_sha256").alias("_any")).distinct()
    single = asked.join(grouped, F.col("_digest") == F.col("_any"), "left_anti")  # held back by chance
    winning = asked.join(kept, own_id.eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_kept")), "left_semi")
    if not decided.groupBy("doc_id", "text_sha256").count().filter("count > 1").isEmpty():  # repeated rows: one of each
        winning = winning.withColumn("_nth", F.row_number().over(Window.partitionBy(id_col, "_digest").orderBy("_digest"))).filter("_nth = 1")
    return split.filter(~F.col("_shared")).select(*names).unionByName(single.select(*names)).unionByName(winning.select(*names))
