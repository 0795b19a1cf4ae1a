"""Parquet, and a cache of converted sources in Parquet."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def read_parquet(spark: SparkSession, path, projection: list[str] | None = None, filter: Column | None = None, cache_dir: str | None = None) -> DataFrame:
    """Parquet with its own schema; filter and projection reach the scan. Timestamps without a zone become UTC timestamps, decimals stay exact.

    cache_dir keeps a copy near by, as cached_read does: for sources that are slow to read.
    """
    df = spark.read.parquet(path) if cache_dir is None else cached_read(spark, path, lambda: spark.read.parquet(path), cache_dir)
    local = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    if filter is not None:
        df = df.filter(filter)
    if projection is not None:
        df = df.select(*projection)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in local if c in df.columns}) if local else df


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    df.write.mode(mode).parquet(path, partitionBy=partition_by)


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, mode: str = "errorifexists") -> None:
    """A table whose joins and groups on keys need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def _state(spark: SparkSession, path: str) -> tuple[str, int]:
    """A key of the source's path, times and sizes, and its latest time, by Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listFiles(p, True)
    files = []
    while found.hasNext():
        f = found.next()
        files.append((str(f.getPath()), f.getModificationTime(), f.getLen()))
    files.sort()
    return hashlib.sha256(repr(files).encode()).hexdigest()[:16], max((t for _, t, _ in files), default=0)


def cached_read(spark: SparkSession, path: str, read: Callable[[], DataFrame], cache_dir: str, variant: str = "") -> DataFrame:
    """The source as read() gives it, converted to Parquet once. cache_dir: a folder that the driver and all executors reach.

    The copy's name is a digest of the source's files, times and sizes and of variant, which tells ways to read it apart; so a changed source gets a new copy. A copy counts once its job
    has committed.
    """
    key, changed = _state(spark, path)
    key = hashlib.sha256(f"{key} {variant}".encode()).hexdigest()[:16]
    target = f"{cache_dir.rstrip('/')}/{key}.parquet"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(done) or fs.getFileStatus(done).getModificationTime() < changed:
        read().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
