"""Schema, plans, exports and row callbacks."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def column_names(df: DataFrame) -> list[str]:
    return df.columns


def dtypes(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def print_schema(df: DataFrame) -> None:
    df.printSchema()


def explain(df: DataFrame) -> str:
    """The formatted plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def count(df: DataFrame) -> int:
    return df.count()


def to_records(df: DataFrame) -> list[dict]:
    """Rows as dicts on the driver: for results, not for tables."""
    return [r.asDict(recursive=True) for r in df.collect()]


def to_columns(df: DataFrame) -> dict[str, list]:
    return df.toArrow().to_pydict()


def stream_rows(df: DataFrame) -> Iterator[dict]:
    """Rows one by one, a partition at a time, so that the driver holds few of them."""
    for r in df.toLocalIterator(prefetchPartitions=True):
        yield r.asDict(recursive=True)


def stream_batches(df: DataFrame, size: int = 1024) -> Iterator[dict[str, list]]:
    """Batches of up to size rows as columns, a partition at a time, so that the driver holds few rows; the last may be smaller, none is empty."""
    rows = df.toLocalIterator(prefetchPartitions=True)
    while held := list(itertools.islice(rows, size)):
        yield {c: [r[i] for r in held] for i, c in enumerate(df.columns)}


def for_each(df: DataFrame, fn: Callable[[dict], None]) -> None:
    """fn on each row, in order, on the driver."""
    for r in stream_rows(df):
        fn(r)


def reduce(df: DataFrame, fn: Callable, initial):
    """A sequential fold on the driver; prefer aggregates."""
    return functools.reduce(fn, stream_rows(df), initial)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """fn on Arrow batches in the executors: the hook for operators of one's own."""

    def run(batches):
        for b in batches:
            yield fn(b)

    return df.mapInArrow(run, schema)


def show(df: DataFrame, n: int = 10) -> None:
    df.show(n, truncate=False)


def length_stats(df: DataFrame, name: str) -> DataFrame:
    """Shortest, longest and mean length of a text column, in code points."""
    n = F.length(name)
    return df.agg(F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"))


def group_by_prefix(df: DataFrame, name: str, size: int) -> DataFrame:
    return df.groupBy(F.substring(name, 1, size).alias("prefix")).agg(F.count("*").alias("count"))


def find_duplicates(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("count")).filter(F.col("count") > 1)
