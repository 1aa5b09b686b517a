"""Structured Streaming forms: throttling, session windows, bounded rounds, idempotent batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..lineage import checkpointed, exists


def throttle_stream(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """(key, event_id, ts) of events that come more than ``seconds`` after the last accepted one of their key.

    ``events`` has key, event_id and ts.  The state of a key is one time; of a batch the times and ids of
    a key are held, in the order of ts.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = sorted(row for frame in frames for row in zip(frame["ts"], frame["event_id"].tolist(), strict=True))
        kept = []
        for at, event in rows:
            if last is None or at.timestamp() - last > seconds:
                last = at.timestamp()
                kept.append((keys[0], event, at))
        state.update((last,))
        yield pd.DataFrame(kept, columns=["key", "event_id", "ts"])

    picked = events.select(F.col(key).alias("key"), "event_id", "ts")
    return picked.groupBy("key").applyInPandasWithState(step, "key long, event_id long, ts timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def session_windows(events: DataFrame, key: str, gap: str = "6 hours", lateness: str = "6 hours") -> DataFrame:
    """(key, started, ended, n): sessions that ``gap`` of silence ends."""
    window = F.session_window("ts", gap).alias("w")
    counted = events.withWatermark("ts", lateness).groupBy(F.col(key).alias("key"), window).agg(F.count("*").alias("n"))
    return counted.select("key", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def with_retries(out: str, work: Callable[[DataFrame, int], DataFrame], limits: dict[str, int]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that tries rows again until they are done or given up.

    ``work`` adds ``failure``, null or one of the kinds in ``limits``; a row that has failed as often as its
    kind allows is a dead letter.  A batch's outcome replaces what an earlier try of it has written.
    """

    def sink(batch: DataFrame, number: int) -> None:
        counters = [f"failed_{k}" for k in limits]
        pending = checkpointed(batch.select("*", *[F.lit(0).alias(c) for c in counters]))
        settled: list[DataFrame] = []
        for attempt in range(1, sum(limits.values()) + 1):
            tried = work(pending, attempt)
            for kind, c in zip(limits, counters, strict=True):
                tried = tried.withColumn(c, F.col(c) + F.when(F.col("failure") == kind, 1).otherwise(0))
            gone = F.lit(False)
            for (_, most), c in zip(limits.items(), counters, strict=True):
                gone = gone | (F.col(c) >= most)
            tried = checkpointed(tried.withColumn("state", F.when(F.col("failure").isNull(), "done").when(gone, "dead")).withColumn("attempts", F.lit(attempt)))
            settled.append(tried.filter("state IS NOT NULL").select(*batch.columns, "state", "attempts"))
            pending = tried.filter("state IS NULL").select(*batch.columns, *counters)
            if pending.isEmpty():
                break
        every = settled[0]
        for more in settled[1:]:
            every = every.unionByName(more)
        every.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return sink


def write_new(out: str, keys: list[str], label: str, bucket: Column) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that leaves out rows whose keys another batch has written; a replayed batch replaces itself.

    What has been written is a ledger in buckets, and a batch looks up the buckets of its own rows only.
    Where ``bucket`` goes with time (the day of an event, say) these are few, and what is read does not
    grow with what was written before.  The same key always has the same bucket.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"{label}-{number}"
        rows = checkpointed(batch.withColumn("bucket", bucket).dropDuplicates(keys))
        mine = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # as many as a batch spans
        there = [path for path in (f"{out}/bucket={b}" for b in mine) if exists(spark, path)]
        if there:
            earlier = spark.read.option("basePath", out).parquet(*there).filter(F.col("batch") != own).select(*keys)
            rows = checkpointed(rows.join(earlier, keys, "left_anti"))
        written = rows.withColumn("batch", F.lit(own)).repartition("bucket").write.partitionBy("bucket", "batch")
        written.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(out)

    return sink


class RoundsSpent(Exception):
    """A run has made as many rounds as it may; the next one goes on from there."""


def run_rounds(stream: DataFrame, sink: Callable[[DataFrame, int], None], state: str, most: int) -> tuple[int, bool]:
    """Runs a stream for ``most`` batches at most: how many it made, and whether anything may be left.

    The batch after the last one is given back before anything of it is written, so that the next run
    begins with it; the checkpoint keeps the place and, beside it, one run at a time.
    """
    done: list[int] = []

    def bounded(batch: DataFrame, number: int) -> None:
        if len(done) == most:
            raise RoundsSpent
        sink(batch, number)
        done.append(number)

    query = stream.writeStream.foreachBatch(bounded).option("checkpointLocation", state).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if "RoundsSpent" not in str(e):
            raise
        return len(done), True
    return len(done), False


def write_once(out: str, work: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink whose replay of a batch leaves one copy: each batch owns its partition."""

    def sink(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return sink
