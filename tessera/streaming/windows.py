"""Event-time windows for batch and stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], *aggregates: Column, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Groups by keys and window (sliding with ``slide``); on a stream rows later than ``late`` are dropped."""
    df = df.withWatermark(time, late) if late and df.isStreaming else df
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return df.groupBy(w.alias("w"), *keys).agg(*aggregates).withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    df = df.withWatermark(time, late) if late and df.isStreaming else df
    return df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates).withColumns({"session_start": F.col("w.start"), "session_end": F.col("w.end")}).drop("w")
