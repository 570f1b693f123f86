"""Event streams: windowed counts with late data, sessions, and a token bucket kept by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.fold import folded

LATE = "30 minutes"


def windowed(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Events by type and window: how many, and the sum of their values. Works on tables and on streams."""
    stream = events.withWatermark("ts", LATE) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = stream.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Runs of a user's events of which none is more than `gap` after the one before."""
    stream = events.withWatermark("ts", LATE) if events.isStreaming else events
    out = stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def _wait(state: tuple, event_id: int, t: float, cost: float, rate: float, size: float, requests: float) -> tuple[tuple, tuple]:
    """The state after one request, and (wait_s, level): one bucket holds tokens, the other requests; both fill steadily.

    A state is (tokens, requests, time reached); the buckets begin full. `requests` a second may come in, a minute's worth
    at most at once, but one at least; 0 for any number.
    """
    tokens, calls, at = state
    most = max(1.0, 60 * requests)
    cost = min(cost, size)
    if at is None:
        tokens, calls, at = size, most, t
    passed = max(0.0, t - at)
    tokens, at = min(size, tokens + passed * rate), max(at, t)
    wait = max(0.0, (cost - tokens) / rate)
    if requests:
        calls = min(most, calls + passed * requests)
        wait = max(wait, (1 - calls) / requests)
        calls = min(most, calls + wait * requests) - 1
    tokens = min(size, tokens + wait * rate) - cost
    at += wait
    return (tokens, calls, at), (at - t, tokens)


def token_bucket(events: DataFrame, key: str, cost: str, rate: float, size: float, requests: float = 0.0) -> DataFrame:
    """(key, event_id, wait_s, level): how long each request of a key waits for its tokens, and its turn, in order of time.

    On a table a key's requests stream through one task, none are held. On a stream the buckets are the key's state, and
    events that come late wait from the time the buckets have reached. A request for more than the bucket holds takes all.
    """
    kind = dict(events.dtypes)[key]
    slim = events.select(key, "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.coalesce(F.col(cost).cast("double"), F.lit(0.0)).alias("cost"))

    def step(state: tuple, event_id: int, t: float, c: float) -> tuple[tuple, tuple]:
        return _wait(state, event_id, t, c, rate, size, requests)

    if not events.isStreaming:
        out = folded(slim, [key], [F.asc("t"), F.asc("event_id")], ["event_id", "t", "cost"], "wait_s double, level double", lambda: (size, 0.0, None), step)
        return out.select(key, F.col("event_id").cast("bigint").alias("event_id"), "wait_s", "level")

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (size, 0.0, None)
        out = []
        for event_id, t, c in pd.concat(list(frames)).sort_values(["t", "event_id"])[["event_id", "t", "cost"]].itertuples(index=False):
            now, (wait, level) = step(now, event_id, t, c)
            out.append((k[0], int(event_id), float(wait), float(level)))
        state.update(now)
        yield pd.DataFrame(out, columns=[key, "event_id", "wait_s", "level"])

    return slim.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id bigint, wait_s double, level double", "tokens double, calls double, at double", "append", "NoTimeout")


def batch_sessions(events: DataFrame, gap_s: int) -> DataFrame:
    """The sessions of a table by window functions, for comparison with those of a stream."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    new = (F.lag(t).over(w).isNull() | (t - F.lag(t).over(w) > gap_s)).cast("int")
    run = events.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return run.groupBy("user_id", "_run").agg(F.min("ts").alias("start"), F.count("*").alias("events")).drop("_run")
