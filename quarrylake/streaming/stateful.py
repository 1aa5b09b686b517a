"""Keyed folds over event time, with timers: what a key has pending is settled when its time comes, not by its next row."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

SECOND = 1_000_000
#: Buckets of keys; a call of the processor and what it reads and writes of the state is for all keys of one.
BUCKETS = 1024


class InOrder(StatefulProcessor):
    """Rows of each key of a bucket in the order of their times, however they arrive.

    Rows later than the watermark wait in the state, so a bucket holds what came in since then, which the
    lateness and the size of a batch bound.  A subclass says in ``step`` what a row changes and in ``due`` when
    something happens without a row; the state of a key is a dictionary of plain values, empty when there is none.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "state string")

    def step(self, key, state: dict, at: int, ident: int, kind: str, item: int | None) -> Iterator[tuple]:
        raise NotImplementedError

    def due(self, state: dict) -> int | None:
        """When the next thing happens by itself, in microseconds."""
        return None

    def lapse(self, key, state: dict, at: int) -> Iterator[tuple]:
        """What happens then."""
        return iter(())

    def _until(self, key, state: dict, at: int) -> Iterator[tuple]:
        while (when := self.due(state)) is not None and when <= at:
            yield from self.lapse(key, state, when)

    def _go(self, new: list[list], mark: int) -> Iterator[pd.DataFrame]:
        edge = mark * 1000 + 999  # the watermark is in milliseconds
        stored = json.loads(self.kept.get()[0]) if self.kept.exists() else {"states": [], "waiting": []}
        states: dict[int | None, dict] = {key: state for key, state in stored["states"]}
        held = sorted(stored["waiting"] + new, key=lambda r: (r[0], r[1]))
        size = bisect_right(held, edge, key=lambda r: r[0])
        out: list[tuple] = []
        for at, ident, kind, item, key in held[:size]:
            state = states.setdefault(key, {})
            out += self._until(key, state, at)
            out += self.step(key, state, at, ident, kind, item)
        for key, state in states.items():
            out += self._until(key, state, edge)
        waiting, states = held[size:], {key: state for key, state in states.items() if state}
        if waiting or states:
            self.kept.update((json.dumps({"states": list(states.items()), "waiting": waiting}),))
        elif self.kept.exists():
            self.kept.clear()
        wakes = [t // 1000 for t in (waiting[0][0] if waiting else None, *map(self.due, states.values())) if t is not None]
        if wakes:
            self.handle.registerTimer(max(mark + 1, min(wakes)))
        if out:
            yield pd.DataFrame(out, columns=self.columns, dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: list[list] = []
        for frame in rows:
            whole = [[None if pd.isna(x) else int(x) for x in frame[c].astype("Int64")] for c in ("item", "key")]
            new += map(list, zip(frame["at"].tolist(), frame["id"].tolist(), frame["kind"].tolist(), *whole, strict=True))
        yield from self._go(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._go([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class SendBatches(InOrder):
    """When what is pending is sent on: with an explicit row, ``most`` implicit ones, a boundary, or ``seconds`` after the oldest."""

    columns, schema = ["key", "at", "reason", "n"], "key long, at long, reason string, n int"

    def __init__(self, most: int, seconds: int):
        self.most, self.wait = most, seconds * SECOND

    def due(self, state: dict) -> int | None:
        return state["oldest"] + self.wait if state else None

    def _send(self, key, state: dict, at: int, reason: str) -> tuple:
        n = state["n"]
        state.clear()
        return key, at, reason, n

    def lapse(self, key, state: dict, at: int) -> Iterator[tuple]:
        yield self._send(key, state, at, "time")

    def step(self, key, state: dict, at: int, ident: int, kind: str, item: int | None) -> Iterator[tuple]:
        if kind in ("implicit", "explicit"):
            state.setdefault("oldest", at)
            state["n"] = state.get("n", 0) + 1
        full = state.get("n", 0) >= self.most
        reason = "explicit" if kind == "explicit" else "full" if full else "boundary" if kind == "boundary" and state else None
        if reason:
            yield self._send(key, state, at, reason)


class Turns(InOrder):
    """Turns as they close: by a reply, by the next prompt, or ``seconds`` after a prompt that nothing follows."""

    columns, schema = ["key", "prompt_at", "reply_at", "state"], "key long, prompt_at long, reply_at long, state string"

    def __init__(self, seconds: int):
        self.wait = seconds * SECOND

    def due(self, state: dict) -> int | None:
        return state["opened"] + self.wait + 1 if state else None

    def lapse(self, key, state: dict, at: int) -> Iterator[tuple]:
        yield key, state.pop("opened"), None, "expired"

    def step(self, key, state: dict, at: int, ident: int, kind: str, item: int | None) -> Iterator[tuple]:
        if state and kind in ("prompt", "reply"):
            yield key, state.pop("opened"), at if kind == "reply" else None, "ready"
        if kind == "prompt":
            state["opened"] = at


class SessionState(InOrder):
    """What a session's state says at each of its prompts; it is forgotten ``seconds`` after the last event.

    The state counts prompts and keeps the last ``most`` items given; ``known`` tells whether the prompt's own
    item was given before.
    """

    columns, schema = ["key", "id", "prompts", "given", "known"], "key long, id long, prompts int, given int, known boolean"

    def __init__(self, seconds: int, most: int = 500):
        self.wait, self.most = seconds * SECOND, most

    def due(self, state: dict) -> int | None:
        return state["last"] + self.wait + 1 if state else None

    def lapse(self, key, state: dict, at: int) -> Iterator[tuple]:
        state.clear()
        return iter(())

    def step(self, key, state: dict, at: int, ident: int, kind: str, item: int | None) -> Iterator[tuple]:
        given = state.setdefault("given", [])
        state["last"], state["prompts"] = at, state.get("prompts", 0) + (kind == "prompt")
        if kind == "prompt":
            yield key, ident, state["prompts"], len(given), item in given
        elif kind == "given":
            state["given"] = [*(x for x in given if x != item), item][-self.most :]


class Cases(InOrder):
    """Changes of the verification cases of a session; ``item`` is the command.

    A failed run opens a case and a later pass of the command resolves it.  A session that is quiet for
    ``seconds`` leaves its open cases unresolved; a failure after that opens the same case again, and a pass
    still resolves it.
    """

    columns, schema = ["key", "command", "opened", "at", "state"], "key long, command long, opened long, at long, state string"

    def __init__(self, seconds: int):
        self.wait = seconds * SECOND

    def due(self, state: dict) -> int | None:
        return state["last"] + self.wait if any(c["open"] for c in state.get("cases", {}).values()) else None

    def lapse(self, key, state: dict, at: int) -> Iterator[tuple]:
        for command, case in state["cases"].items():
            if case["open"]:
                case["open"] = False
                yield key, int(command), case["id"], at, "unresolved"

    def step(self, key, state: dict, at: int, ident: int, kind: str, item: int | None) -> Iterator[tuple]:
        state["last"] = at
        cases = state.setdefault("cases", {})
        case = cases.get(str(item))
        if kind == "failed" and case is None:
            cases[str(item)] = {"id": ident, "open": True}
            yield key, item, ident, at, "opened"
        elif kind == "failed" and not case["open"]:
            case["open"] = True
            yield key, item, case["id"], at, "reopened"
        elif kind == "passed" and case is not None:
            yield key, item, cases.pop(str(item))["id"], at, "resolved"
        if not cases:
            state.clear()


def use_state_store(spark: SparkSession) -> None:
    """Timers and named states need the store that keeps its tables outside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def folded(events: DataFrame, key: str, processor: InOrder, lateness: str = "10 minutes") -> DataFrame:
    """What a processor makes of a stream with ``key``, event_id, ts, kind and item."""
    use_state_store(events.sparkSession)
    picked = events.select(F.col(key).cast("long").alias("key"), "ts", F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"), "kind", F.col("item").cast("long").alias("item"))
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket")
    return picked.select(bucket, "*").withWatermark("ts", lateness).groupBy("bucket").transformWithStateInPandas(processor, processor.schema, "Append", "EventTime")
