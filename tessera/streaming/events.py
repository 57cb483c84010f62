"""Event streams: windows with watermarks, dedup, and a stateful rate limiter.

The same functions run on a batch and on a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
ALLOWED = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("allowed", T.BooleanType())])
RECENT = T.StructType([T.StructField("recent", T.ArrayType(T.DoubleType()))])


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of a folder as a stream of events."""
    return spark.readStream.schema(EVENTS).parquet(folder)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicates(["event_id", "ts"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def limited(times: list[float], recent: list[float], most: int, window: float) -> tuple[list[bool], list[float]]:
    """Which of the times pass: fewer than ``most`` that passed lie within the window before; what does not pass is not counted."""
    out = []
    for t in times:
        recent = [r for r in recent if t - r < window]
        ok = len(recent) < most
        recent = [*recent, t] if ok else recent
        out.append(ok)
    return out, recent


def rate_limited(events: DataFrame, most: int = 30, seconds: float = 60.0) -> DataFrame:
    """Rows (user_id, event_id, allowed) of a batch: the limiter's fold along each user's events.

    Users are sorted apart and their events streamed in order, so a task holds a batch and
    the at most ``most`` times that still count, however many events a user has.
    """
    rows = events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, recent = None, []
        for batch in batches:
            out = []
            for key, part in batch.groupby("user_id", sort=False, dropna=False):
                same = key == user or (key != key and user != user)
                allowed, recent = limited(part["t"].tolist(), recent if same else [], most, seconds)
                user = key
                out.append(pd.DataFrame({"user_id": part["user_id"], "event_id": part["event_id"], "allowed": allowed}))
            if out:
                yield pd.concat(out)

    return rows.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id").mapInPandas(run, ALLOWED)


def rate_limited_stream(events: DataFrame, most: int = 30, seconds: float = 60.0) -> DataFrame:
    """The limiter on a stream: the state of a user is the times that passed within the window."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed, recent = limited([t.timestamp() for t in rows["ts"]], recent, most, seconds)
        state.update((recent,))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "allowed": allowed})

    return events.groupBy("user_id").applyInPandasWithState(step, ALLOWED, RECENT, "append", "NoTimeout")


def since(events: DataFrame, day: str, most: int) -> DataFrame:
    """Watch feed: items on or after a day, the newest first, at most some."""
    return events.where(F.col("ts") >= F.lit(day).cast("timestamp")).orderBy(F.desc("ts"), F.desc("event_id")).limit(most)
