"""Event streams: windowed counts with watermarks, sessions, and a running top score."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, per_trigger: int = 16) -> DataFrame:
    """A stream of Parquet files, ``per_trigger`` a batch; the time column as a timestamp, as watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, total) of each window; rows later than the watermark are dropped by streams."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a gap."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def running_best(events: DataFrame) -> DataFrame:
    """A stream of (user_id, best, seen): each user's highest value so far, kept as state."""

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, seen = state.get if state.exists else (float("-inf"), 0)
        for pdf in batches:
            best, seen = max(best, float(pdf.value.max())), seen + len(pdf)
        state.update((best, seen))
        yield pd.DataFrame({"user_id": [key[0]], "best": [best], "seen": [seen]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, best double, seen bigint", "best double, seen bigint", "update", "NoTimeout")
