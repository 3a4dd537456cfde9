"""Event streams: status machine, rate limits, lockout, windows, retention, progress. Each has a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Which event may follow which; anything may begin.
NEXT = {"signup": ("view", "click"), "view": ("view", "click", "purchase"), "click": ("view", "click", "purchase", "error"), "purchase": ("view", "signup"), "error": ("view", "click")}


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet event files as a stream; times become timestamps for watermarks."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def attempts_in_window(events: DataFrame, key: str, minutes: int = 15) -> DataFrame:
    """How many attempts of a key lie within the minutes before and at each one."""
    w = Window.partitionBy(key).orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-60 * minutes, 0)
    return events.withColumn("n_in_window", F.count("*").over(w))


def _in_order(events: DataFrame, key: str, columns: list[str], start, step, result: str, kind: str) -> DataFrame:
    """event_id and step(state, *columns) for each event, a key's events in order of time; only one key's state is held.

    However many events a key has, they pass in batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last, began = None, None, False
        for rows in batches:
            out = []
            for k, *values in rows[[key, *columns]].itertuples(index=False, name=None):
                k = None if pd.isna(k) else k
                if not began or k != last:
                    state, last, began = start(), k, True
                out.append(step(state, *values))
            yield pd.DataFrame({"event_id": rows["event_id"], result: out})

    rows = events.select(key, "event_id", *columns).repartition(F.col(key)).sortWithinPartitions(key, "ts", "event_id")
    return rows.mapInPandas(run, f"event_id long, {result} {kind}")


def rate_limited(events: DataFrame, key: str, most: int = 10, minutes: int = 15) -> DataFrame:
    """event_id, allowed: at most `most` allowed attempts within any `minutes`; rejected ones do not count. State: the allowed times that still count."""

    def step(kept: list, t) -> bool:
        kept[:] = [k for k in kept if t - k < pd.Timedelta(minutes=minutes)]
        if len(kept) < most:
            kept.append(t)
            return True
        return False

    return _in_order(events, key, ["ts"], list, step, "allowed", "boolean")


def lockouts(events: DataFrame, key: str, limit: int = 5, minutes: int = 15) -> DataFrame:
    """event_id, state: `limit` failures in a row lock a key for some minutes; expiry clears the count. State: failures, end of the lock."""

    def step(s: dict, t, kind: str) -> str:
        if s["until"] is not None and t < s["until"]:
            return "locked"
        if s["until"] is not None:
            s["failed"], s["until"] = 0, None
        s["failed"] = s["failed"] + 1 if kind == "error" else 0
        if s["failed"] < limit:
            return "open"
        s["until"] = t + pd.Timedelta(minutes=minutes)
        return "lock"

    return _in_order(events, key, ["ts", "event_type"], lambda: {"failed": 0, "until": None}, step, "state", "string")


def invalid_transitions(events: DataFrame, key: str) -> DataFrame:
    """Events that may not follow the one before."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, to in NEXT.items() for b in to])
    e = events.withColumn("from_status", F.lag("event_type").over(w))
    return e.where(F.col("from_status").isNotNull() & ~F.array_contains(pairs, F.concat_ws(">", "from_status", "event_type"))).select(key, "event_id", "from_status", F.col("event_type").alias("to_status"))


class StatusMachine:
    """Stateful streaming twin of invalid_transitions: keeps each key's last status."""

    def __init__(self, key: str):
        self.key = key

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (None,)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for event_id, kind in zip(rows["event_id"], rows["event_type"], strict=True):
            if last is not None and kind not in NEXT[last]:
                out.append((key[0], event_id, last, kind))
            last = kind
        state.update((last,))
        yield pd.DataFrame(out, columns=[self.key, "event_id", "from_status", "to_status"])


def stream_invalid_transitions(stream: DataFrame, key: str) -> DataFrame:
    out = f"{key} long, event_id long, from_status string, to_status string"
    return stream.groupBy(key).applyInPandasWithState(StatusMachine(key), out, "last string", "append", "NoTimeout")


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and values by window and type; the watermark holds for streams and does nothing in batch."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, key: str, gap: str = "6 hours") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start_at"), "n")


def retained(rows: DataFrame, now: str, days: int = 14) -> DataFrame:
    return rows.where(F.col("ts").cast("timestamp") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def progress(jobs: DataFrame, key: str) -> DataFrame:
    """Running totals by job for update-mode streams (and batch)."""
    return jobs.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") == "error").alias("failed"))


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there, into a memory table, and returns the table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
