"""Windows over event time, for batch and streams alike; an extension of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    """window_start, keys, n. With `late`, a stream's state is dropped that long after event time."""
    df = events.withWatermark(ts, late) if late else events
    return df.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sliding(events: DataFrame, ts: str, width: str, step: str, keys: list[str], late: str | None = None) -> DataFrame:
    df = events.withWatermark(ts, late) if late else events
    return df.groupBy(F.window(ts, width, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """session_start, session_end (of the gap), keys, n."""
    df = events.withWatermark(ts, late) if late else events
    return df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")
