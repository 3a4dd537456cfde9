"""Keyed guards over event streams: sliding-window rate limits, lockouts, status machines with compare-and-set.

Each is a fold over one key's events in order of time, with a small state. guard() runs a fold as a stream:
state lives in the state store between micro-batches, an event-time timer (rates, lockouts) or a time to live (statuses) clears the state of
idle keys, and each row gets an outcome. folded() runs the same fold over a finished table. A micro-batch of one key is
held in order of time as slim columns; the size of micro-batches bounds it (maxFilesPerTrigger, maxBytesPerTrigger).

Rows that come later than their key's state are not counted: outcome late. A null key is let through and not counted.
Streams need the RocksDB state store: stateful(spark) sets it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

SECOND = 1_000_000  # times are microseconds
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


class RateLimit:
    """allowed, or rejected with the seconds to wait: at most `most` allowed events within any `seconds`; rejected ones do not count."""

    state, columns, result = "times array<long>", (), "outcome string, retry_after long"

    def __init__(self, most: int = 10, seconds: int = 900):
        self.most, self.window = most, seconds * SECOND

    def begin(self):
        return deque()

    def load(self, row):
        return deque(row[0])

    def save(self, times):
        return (list(times),)

    def last(self, times):
        return times[-1] if times else None

    def step(self, times, at):
        while times and at - times[0] >= self.window:
            times.popleft()
        if len(times) >= self.most:
            return times, ("rejected", max(1, (self.window - (at - times[0])) // SECOND))
        times.append(at)
        return times, ("allowed", None)

    def ends(self, times):
        return times[-1] + self.window if times else None


class Lockout:
    """open, lock or locked: `limit` failures in a row lock a key for some seconds; expiry clears the count, as a success does."""

    state, result = "failed int, until long, at long", "outcome string, failures int"

    def __init__(self, limit: int = 5, seconds: int = 900, failure: str = "error", column: str = "event_type"):
        self.limit, self.seconds, self.failure, self.columns = limit, seconds * SECOND, failure, (column,)

    def begin(self):
        return (0, None, None)

    def load(self, row):
        return (row[0], row[1], row[2])

    def save(self, s):
        return s

    def last(self, s):
        return s[2]

    def step(self, s, at, kind):
        failed, until, _ = s
        if until is not None and at < until:
            return (failed, until, at), ("locked", failed)
        failed = 0 if until is not None else failed
        failed = failed + 1 if kind == self.failure else 0
        until = at + self.seconds if failed >= self.limit else None
        return (failed, until, at), ("open" if until is None else "lock", failed)

    def ends(self, s):
        return s[1]


class Statuses:
    """applied, stale (the expected status is not the present one), invalid (the machine has no such step) or gated (a step that waits for approval)."""

    state, result = "status string, at long", "outcome string, from_status string, to_status string"

    def __init__(self, following: dict[str, tuple[str, ...]], expected: str = "expected", to: str = "event_type", gates: dict[str, str] | None = None):
        self.following, self.gates, self.columns = following, gates or {}, (expected, to)

    def begin(self):
        return (None, None)

    def load(self, row):
        return (row[0], row[1])

    def save(self, s):
        return s

    def last(self, s):
        return s[1]

    def step(self, s, at, expected, to):
        now = s[0]
        if expected != now:
            return (now, at), ("stale", now, to)
        if now is not None and to not in self.following.get(now, ()):
            return (now, at), ("invalid", now, to)
        if to in self.gates:
            return (self.gates[to], at), ("gated", now, self.gates[to])
        return (to, at), ("applied", now, to)

    def ends(self, s):
        return None


def _steps(fold, state, rows: Iterator[tuple]) -> tuple[object, list[tuple]]:
    out, nothing = [], (None,) * (fold.result.count(",") + 1)
    for event_id, at, *values in rows:
        last = fold.last(state)
        if last is not None and at < last:
            out.append((event_id, "late", *nothing[1:]))
            continue
        state, result = fold.step(state, at, *[None if pd.isna(v) else v for v in values])
        out.append((event_id, *result))
    return state, out


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


class _Processor(StatefulProcessor):
    def __init__(self, fold, ttl_ms: int | None):
        self.fold, self.ttl_ms = fold, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.fold.state, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        fold, columns = self.fold, ["event_id", "at", *self.fold.columns]
        frame = pd.concat([r[columns] for r in rows]).sort_values(["at", "event_id"], kind="stable")
        if not key[0]:
            state, out = None, [(e, *fold.step(fold.begin(), a, *v)[1]) for e, a, *v in frame.itertuples(index=False, name=None)]
        else:
            state = fold.load(self.kept.get()) if self.kept.exists() else fold.begin()
            state, out = _steps(fold, state, frame.itertuples(index=False, name=None))
            self.kept.update(fold.save(state))
            if self.ttl_ms is None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                if (end := fold.ends(state)) is not None:
                    self.handle.registerTimer(end // 1000 + 1)
        result = pd.DataFrame(out, columns=["event_id", *_names(fold.result)], dtype=object)
        result.insert(0, "key", pd.Series([key[1] if key[0] else None] * len(result), dtype=object))
        yield result

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What has expired counts no more: the key needs no state."""
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def _prepared(events: DataFrame, fold, key: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    columns = [c for c in fold.columns if c not in ("key", "at", "ts", "event_id")]
    return events.select(F.col(key).alias("key"), "event_id", F.unix_micros(ts).alias("at"), ts.alias("ts"), *columns)


def guard(stream: DataFrame, fold, key: str, late: str = "0 seconds", ttl_days: int | None = None) -> DataFrame:
    """key, event_id and the fold's result for each event of a stream. ttl_days: state is kept so long after it was last
    written (by the clock); otherwise a timer clears it when, by the events' time, nothing in it counts."""
    rows = _prepared(stream, fold, key)
    kind = rows.schema["key"].dataType.simpleString()
    rows = rows.withWatermark("ts", late) if ttl_days is None else rows
    rows = rows.withColumns({"_keyed": F.col("key").isNotNull(), "_key": F.coalesce("key", F.lit(0).cast(kind))})  # the state store takes no null keys
    processor = _Processor(fold, None if ttl_days is None else ttl_days * 86_400_000)
    out = f"key {kind}, event_id {rows.schema['event_id'].dataType.simpleString()}, {fold.result}"
    return rows.groupBy("_keyed", "_key").transformWithStateInPandas(processor, out, "append", "eventTime" if ttl_days is None else "processingTime")


def folded(events: DataFrame, fold, key: str) -> DataFrame:
    """The same over a finished table: one key's state is held, its events pass in batches."""
    rows = _prepared(events, fold, key).drop("ts")
    kind = rows.schema["key"].dataType.simpleString()
    columns = ["event_id", "at", *fold.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last, began = None, None, False
        for batch in batches:
            for _, own in batch.groupby(batch["key"].isna().astype(int).astype(str) + batch["key"].astype(str), sort=False):
                k = own["key"].iloc[0]
                k = None if pd.isna(k) else k
                state, last, began = (state if began and k == last else fold.begin()), k, True
                if k is None:
                    out = [(e, *fold.step(fold.begin(), a, *v)[1]) for e, a, *v in own[columns].itertuples(index=False, name=None)]
                else:
                    state, out = _steps(fold, state, own[columns].itertuples(index=False, name=None))
                frame = pd.DataFrame(out, columns=["event_id", *_names(fold.result)], dtype=object)
                frame.insert(0, "key", pd.Series([k] * len(frame), dtype=object))
                yield frame

    rows = rows.repartition(F.col("key")).sortWithinPartitions("key", "at", "event_id")
    return rows.mapInPandas(run, f"key {kind}, event_id {rows.schema['event_id'].dataType.simpleString()}, {fold.result}")
