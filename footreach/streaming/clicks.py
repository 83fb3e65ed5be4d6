"""Click streams. An extension: the same functions serve batch tables and streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def click_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of clicks as they arrive in a folder."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # event time must have a zone


def timed(clicks: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream whose rows may be late by so much; set once, before the functions below."""
    return clicks.withWatermark("ts", late) if clicks.isStreaming else clicks


def sessions(clicks: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, clicks, total): clicks of a user without a longer pause. Late rows are dropped on streams."""
    return clicks.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("clicks"), F.round(F.sum("value"), 6).alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "clicks", "total")


def once_each(clicks: DataFrame) -> DataFrame:
    """Requests without repeats of an event within the watermark: the stream form of a cache with a time limit."""
    return clicks.dropDuplicatesWithinWatermark(["event_id"]) if clicks.isStreaming else clicks.dropDuplicates(["event_id"])


def answer(clicks: DataFrame, respond: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Runs `respond` over each micro-batch and appends its rows; starts and returns the query."""
    return clicks.writeStream.foreachBatch(lambda batch, _: respond(batch).write.mode("append").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tokens_left(times, rate: float = 2.0, burst: float = 2.0):
    """How many of the sorted epoch seconds `times` (an array column) a token bucket lets pass without waiting."""
    start = F.struct(F.lit(burst).alias("tokens"), F.lit(None).cast("double").alias("last"), F.lit(0).cast("long").alias("passed"))

    def step(s, t):
        level = F.least(F.lit(burst), s["tokens"] + F.coalesce(t - s["last"], F.lit(0.0)) * rate)
        ok = level >= 1
        return F.struct(F.when(ok, level - 1).otherwise(level).alias("tokens"), t.alias("last"), (s["passed"] + ok.cast("long")).alias("passed"))

    return F.aggregate(times, start, step, lambda s: s["passed"])


def tokens_left_by_tick(ticks, rate: float = 2.0, burst: float = 2.0):
    """The same from `ticks`, an array of (t, n) sorted by t with the calls of each instant counted: its size follows the
    time covered, not the number of calls."""
    start = F.struct(F.lit(burst).alias("tokens"), F.lit(None).cast("double").alias("last"), F.lit(0).cast("long").alias("passed"))

    def step(s, x):
        level = F.least(F.lit(burst), s["tokens"] + F.coalesce(x["t"] - s["last"], F.lit(0.0)) * rate)
        through = F.least(x["n"], F.floor(level))
        return F.struct((level - through).alias("tokens"), x["t"].alias("last"), (s["passed"] + through).alias("passed"))

    return F.aggregate(ticks, start, step, lambda s: s["passed"])


def _by_key(calls: DataFrame, key: str, out: str, state: str, step: Callable, lasts: Callable) -> DataFrame:
    """A stream of calls (event_id, key, ts) folded by key in the order of ts and event_id within a micro-batch.

    `step(state, t)` gives the next state and the call's result; `lasts(state)` the epoch second from which the state is the
    same as none, when it is dropped. A call that comes later than one already answered counts at the latter's time."""

    def fold(keys: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")  # what a micro-batch has of one key
        now = group.get if group.exists else None
        results = []
        for t in rows["second"]:
            now, result = step(now, float(t))
            results.append(result)
        group.update(now)
        group.setTimeoutTimestamp(max(int(lasts(now) * 1000) + 1, group.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: keys[0], "event_id": rows["event_id"].to_numpy(), "ts": rows["ts"].to_numpy(), out.split()[0]: results})

    kind = calls.schema[key].dataType.simpleString()
    number = calls.schema["event_id"].dataType.simpleString()
    return calls.select(key, "event_id", "ts", (F.unix_micros("ts") / 1e6).alias("second")).groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, event_id {number}, ts timestamp, {out}", state, "append", GroupStateTimeout.EventTimeTimeout)


def waits(calls: DataFrame, rate: float = 2.0, key: str = "user_id") -> DataFrame:
    """(key, event_id, ts, wait_s): how long a stream's calls wait for a token of their key's bucket, one call after the other.

    A bucket holds max(1, rate) tokens and gains `rate` a second. A call that finds less than one waits for the rest, and
    leaves none; what comes in while it sleeps is the next one's. Full buckets are forgotten."""
    full = max(1.0, rate)

    def step(state: tuple | None, t: float) -> tuple[tuple, float]:
        tokens, since, free = state or (full, t, t)
        now = max(t, free)
        tokens = min(full, tokens + (now - since) * rate)
        wait = 0.0 if tokens >= 1.0 else (1.0 - tokens) / rate
        return (tokens - 1.0 if tokens >= 1.0 else 0.0, now, now + wait), now - t + wait

    return _by_key(calls, key, "wait_s double", "tokens double, since double, free double", step, lambda s: max(s[2], s[1] + full / rate))


def cache_hits(calls: DataFrame, lasts_s: float = 86_400.0, key: str = "user_id") -> DataFrame:
    """(key, event_id, ts, hit): whether an answer to a stream's call is in the cache: one made at most `lasts_s` before. A
    call without one makes it; hits don't prolong it. Answers out of date are forgotten."""

    def step(state: tuple | None, t: float) -> tuple[tuple, bool]:
        hit = state is not None and t - state[0] <= lasts_s
        return (state if hit else (t,)), hit

    return _by_key(calls, key, "hit boolean", "made double", step, lambda s: s[0] + lasts_s)
