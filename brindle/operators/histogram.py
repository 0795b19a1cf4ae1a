"""Histograms that are counted where the rows are."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .rows import _known


def histogram(df: DataFrame, name: str, bins: int = 10) -> DataFrame:
    """bin, low, high, count for bins of equal width; nulls and NaN are left out, the maximum is in the last bin, a single value is widened by one on both sides. No rows give no bins.

    One aggregate finds the bounds, another counts; bins without rows come from a range.
    """
    _known(df, [name])
    v = F.col(name).cast("double")
    values = df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    low, high = values.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, count long")
    if low == high:
        low, high = low - 1, high + 1
    width = (high - low) / bins
    index = F.greatest(F.lit(0), F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))).cast("int")
    counts = values.groupBy(index.alias("bin")).agg(F.count("*").alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edge = lambda n: F.lit(low) + n * F.lit(width)
    return every.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))
