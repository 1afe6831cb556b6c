"""Event-time rollups and duplicate removal on a stream of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, tag: str, value: str, ts: str = "ts", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count, mean and extremes per tag and window; rows later than `late` are dropped."""
    return _rollup(df.withWatermark(ts, late), F.window(ts, width), tag, value)


def sliding(df: DataFrame, tag: str, value: str, ts: str = "ts", width: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    return _rollup(df.withWatermark(ts, late), F.window(ts, width, step), tag, value)


def sessions(df: DataFrame, tag: str, value: str, ts: str = "ts", gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    return _rollup(df.withWatermark(ts, late), F.session_window(ts, gap), tag, value)


def _rollup(df, frame, tag, value):
    found = df.groupBy(frame.alias("frame"), tag).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    return found.select(
        tag, F.col("frame.start").alias("start"), F.col("frame.end").alias("end"), "n", "mean", "low", "high"
    )


def drop_repeats(df: DataFrame, columns: list[str], ts: str = "ts", late: str = "2 days") -> DataFrame:
    """First row per key while the key is younger than the watermark delay."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(columns)
