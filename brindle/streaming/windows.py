"""Event-time windows, the same over tables and streams (an extension: the data model itself has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..types import fresh_name


def windowed(df: DataFrame, time: str, keys: list[str], aggregates: dict, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """window_start, window_end, keys and aggregates per window; for a stream, late is the watermark's delay."""
    if late:
        df = df.withWatermark(time, late)
    held = fresh_name(df, "window")
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = df.groupBy(window.alias(held), *keys).agg(*(e.alias(n) for n, e in aggregates.items()))
    return out.select(F.col(held)["start"].alias("window_start"), F.col(held)["end"].alias("window_end"), *keys, *aggregates)


def sessions(df: DataFrame, time: str, keys: list[str], aggregates: dict, gap: str, late: str | None = None) -> DataFrame:
    """Runs of rows of a key with no gap of that length."""
    if late:
        df = df.withWatermark(time, late)
    held = fresh_name(df, "window")
    out = df.groupBy(F.session_window(time, gap).alias(held), *keys).agg(*(e.alias(n) for n, e in aggregates.items()))
    return out.select(F.col(held)["start"].alias("window_start"), F.col(held)["end"].alias("window_end"), *keys, *aggregates)


def stream_table(spark, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
