"""As-of joins, turn pairing, throttling and budget packing over keyed, ordered rows.

The as-of joins work in two levels, so that a key which holds a large share of the rows is not one
sorted task: rows are dealt by key and time bucket, each bucket passes its last (first) match on, and
only one row per bucket takes part in the second level.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(df: DataFrame, key: str, ts: str, tie: str, value: Column, name: str, forward: bool = False, bucket: str = "day") -> DataFrame:
    """Adds ``name``: the latest non-null ``value`` at or before each row of its key (or the next at or after it).

    ``tie`` orders rows with equal times.  Rows without a match get null.
    """
    marked = df.withColumn("_b", F.date_trunc(bucket, F.col(ts))).withColumn("_v", value)
    order = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    inside = Window.partitionBy(key, "_b").orderBy(order(ts), order(tie)).rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct(F.col(ts), F.col(tie), F.col("_v"))
    pick = F.min if forward else F.max
    ends = marked.groupBy(key, "_b").agg(pick(F.when(F.col("_v").isNotNull(), at)).alias("_e"))
    across = Window.partitionBy(key).orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "_b", F.last("_e._v", ignorenulls=True).over(across).alias("_c"))
    return marked.withColumn("_i", F.last("_v", ignorenulls=True).over(inside)).join(carried, [key, "_b"]).withColumn(name, F.coalesce("_i", "_c")).drop("_b", "_v", "_i", "_c")


def running_count(df: DataFrame, key: str, ts: str, tie: str, flag: Column, name: str, bucket: str = "day") -> DataFrame:
    """Adds ``name``: how many rows of the key up to and with this one have ``flag``."""
    marked = df.withColumn("_b", F.date_trunc(bucket, F.col(ts))).withColumn("_f", F.when(flag, 1).otherwise(0))
    inside = Window.partitionBy(key, "_b").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy(key, "_b").agg(F.sum("_f").alias("_s")).select(key, "_b", F.coalesce(F.sum("_s").over(across), F.lit(0)).alias("_c"))
    return marked.withColumn("_i", F.sum("_f").over(inside)).join(sums, [key, "_b"]).withColumn(name, F.col("_i") + F.col("_c")).drop("_b", "_f", "_i", "_c")


def pair_turns(df: DataFrame, key: str, ts: str, tie: str, prompt: Column, reply: Column) -> DataFrame:
    """(key, turn, prompt_at, prompt_tie, reply_at, reply_tie): each prompt with the first reply before the next prompt."""
    islands = running_count(df, key, ts, tie, prompt, "turn").filter("turn > 0")
    at = F.struct(F.col(ts).alias("at"), F.col(tie).alias("tie"))
    turns = islands.groupBy(key, "turn").agg(F.min(F.when(prompt, at)).alias("p"), F.min(F.when(reply, at)).alias("r"))
    return turns.select(key, "turn", F.col("p.at").alias("prompt_at"), F.col("p.tie").alias("prompt_tie"), F.col("r.at").alias("reply_at"), F.col("r.tie").alias("reply_tie"))


def throttle(df: DataFrame, keys: list[str], ts: str, tie: str, seconds: float) -> DataFrame:
    """Rows that come more than ``seconds`` after the last accepted row of their key.

    The gap counts from the last accepted row, not the last seen one, so this is a fold over the sorted
    rows of a key; it is streamed, and no key is held in memory.
    """
    columns = df.columns
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, ts, tie)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last_at = None, None
        for batch in batches:
            keep = []
            for key, at in zip(zip(*(batch[k].tolist() for k in keys), strict=True), batch[ts], strict=True):
                ok = key != last_key or (at - last_at).total_seconds() > seconds
                if ok:
                    last_key, last_at = key, at
                keep.append(ok)
            yield batch[keep]

    return dealt.mapInPandas(run, df.schema).select(*columns)


def pack_budget(df: DataFrame, key: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Adds ``taken``: greedy packing per key in the given order that skips what does not fit and goes on."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", taken boolean"
    dealt = df.repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, used = None, 0
        for batch in batches:
            taken = []
            for k, c in zip(batch[key].tolist(), batch[cost].tolist(), strict=True):
                if k != last:
                    last, used = k, 0
                taken.append(used + c <= budget)
                used += c if taken[-1] else 0
            yield batch.assign(taken=taken)

    return dealt.mapInPandas(run, schema)


def streak(df: DataFrame, key: str, ts: str, tie: str, bad: Column, good: Column, name: str) -> DataFrame:
    """Adds ``name``: bad rows since the last good one."""
    islands = running_count(df, key, ts, tie, good, "_island").withColumn("_key", F.struct(key, "_island"))
    return running_count(islands, "_key", ts, tie, bad, name).drop("_key", "_island")


def rolling_count(df: DataFrame, key: str, ts: str, tie: str, hours: int, name: str) -> DataFrame:
    """Adds ``name``: rows of the key in the ``hours`` up to and with each row's time.

    Rows are dealt by key and time bucket of that length; each bucket also gets a copy of the bucket
    before it, so a window never spans more than two buckets of one key.
    """
    width = hours * 3600
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    marked = df.withColumn("_us", at).withColumn("_own", F.floor(at / (width * 1_000_000)))
    copies = marked.withColumn("_b", F.explode(F.array("_own", F.col("_own") + 1)))
    inside = Window.partitionBy(key, "_b").orderBy("_us").rangeBetween(-width * 1_000_000, 0)
    return copies.withColumn(name, F.count("*").over(inside)).filter("_b = _own").drop("_us", "_own", "_b")


def send_batches(df: DataFrame, key: str, ts: str, tie: str, kind: str, most: int, seconds: float) -> DataFrame:
    """(key, tie, reason, n): when what is pending of each key is sent on, and how much that is.

    ``kind`` is implicit, explicit, boundary or anything else.  Explicit rows are sent at once with all that
    waits; implicit ones wait for ``most`` of them, a boundary, or until the oldest is ``seconds`` old, which
    the next row of the key notices.  Rows are streamed in order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, oldest = None, 0, None
        for batch in batches:
            out = []
            for k, t, i, what in zip(batch[key].tolist(), batch[ts], batch[tie].tolist(), batch[kind], strict=True):
                if k != at:
                    at, held, oldest = k, 0, None
                if held and (t - oldest).total_seconds() >= seconds:
                    out.append((k, i, "time", held))
                    held, oldest = 0, None
                if what in ("implicit", "explicit"):
                    held, oldest = held + 1, oldest if held else t
                reason = "explicit" if what == "explicit" else "full" if held >= most else "boundary" if what == "boundary" and held else None
                if reason:
                    out.append((k, i, reason, held))
                    held, oldest = 0, None
            yield pd.DataFrame(out, columns=[key, tie, "reason", "n"])

    kinds = dict(df.dtypes)
    return df.repartition(key).sortWithinPartitions(key, ts, tie).mapInPandas(run, f"`{key}` {kinds[key]}, `{tie}` {kinds[tie]}, reason string, n int")


def admit(df: DataFrame, key: str, kind: str, at: str, tie: str, most: dict[str, int], seconds: int) -> DataFrame:
    """Adds ``admitted`` and ``waited``: when each call of a key is made under a sliding budget.

    ``at`` is in microseconds; a key has one kind, which may make ``most`` calls in any ``seconds``.  Only calls
    that were made count.  One that finds no room waits, with those after it, and is tried again when the
    oldest call that counts is too old; a kind without a budget never calls (null).  A key's state is the
    times of its last calls, as many as its budget.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", admitted long, waited boolean"
    span = seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, made = None, deque()
        for batch in batches:
            admitted: list[int | None] = []
            for k, what, t in zip(batch[key].tolist(), batch[kind].tolist(), batch[at].tolist(), strict=True):
                if k != last:
                    last, made = k, deque(maxlen=max(1, most.get(what, 0)))
                if most.get(what, 0) < 1:
                    admitted.append(None)
                    continue
                full = len(made) == made.maxlen
                made.append(max(t, made[-1] if made else t, made[0] + span + 1 if full else t))
                admitted.append(made[-1])
            times = pd.array(admitted, dtype="Int64")
            yield batch.assign(admitted=times, waited=[a is None or a > t for a, t in zip(admitted, batch[at].tolist(), strict=True)])

    return df.repartition(key).sortWithinPartitions(key, at, tie).mapInPandas(run, schema)
