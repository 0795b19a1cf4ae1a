"""Sorting and paging."""

from __future__ import annotations

from dataclasses import dataclass, replace as _replace

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import BrindleError, SchemaError
from ..storage import materialised
from ..types import fresh_name
from .rows import _known


#: Up to so many rows a slice is left to Spark's top-k plan, which keeps them in one task.
FEW = 100_000


@dataclass(frozen=True)
class SortKey:
    """A column with its direction; nulls come last unless said otherwise, in both directions."""

    name: str
    descending: bool = False
    nulls_first_: bool = False

    def nulls_first(self) -> SortKey:
        return _replace(self, nulls_first_=True)

    def nulls_last(self) -> SortKey:
        return _replace(self, nulls_first_=False)

    def column(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first_ else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first_ else c.asc_nulls_last()


def asc(name: str) -> SortKey:
    return SortKey(name)


def desc(name: str) -> SortKey:
    return SortKey(name, descending=True)


def _keys(keys) -> list[SortKey]:
    keys = [keys] if isinstance(keys, (str, SortKey)) else list(keys)
    if not keys:
        raise BrindleError("sorting needs a key")
    return [SortKey(k) if isinstance(k, str) else k for k in keys]


def sort(df: DataFrame, *keys) -> DataFrame:
    """By names or keys; text compares by its UTF-8 bytes. Equal rows have no order: add a key that breaks ties."""
    found = [k for group in keys for k in _keys(group)]
    _known(df, [k.name for k in found])
    return df.orderBy(*(k.column() for k in found))


order_by = sort


def limit(df: DataFrame, n: int) -> DataFrame:
    if n < 0:
        raise BrindleError("a limit is not negative")
    return df.limit(n)


def head(df: DataFrame, n: int = 5) -> DataFrame:
    return limit(df, n)


def _numbered(df: DataFrame) -> tuple[DataFrame, str, int]:
    """df, written, with the number of each row from 0 in the order of partitions, the number's column, and the number of rows.

    Partitions are counted, a bounded table that reaches the driver, so that no task sees all rows.
    """
    at, number = fresh_name(df, "at"), fresh_name(df, "number")
    kept = materialised(df.withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)
    counts = sorted(kept.groupBy(part.alias("part")).count().collect())
    total, starts = 0, {}
    for p, n in counts:
        starts[p] = total
        total += n
    if not counts:
        return kept.withColumn(number, F.col(at)).drop(at), number, 0
    start = kept.sparkSession.createDataFrame([(p, s) for p, s in starts.items()], "part long, start long").select(F.struct("*").alias(found := fresh_name(kept, "found")))
    joined = kept.join(start, part == start[found]["part"])
    return joined.withColumn(number, F.col(found)["start"] + F.col(at).bitwiseAND((1 << 33) - 1)).drop(found, at), number, total


def number_rows(df: DataFrame, name: str = "row", start: int = 0) -> DataFrame:
    """df with the number of each row, from start, in the order of its rows: after a sort by a total order, their ranks."""
    if name in df.columns:
        raise SchemaError(f"there is a column {name!r}")
    rows, number, _ = _numbered(df)
    return rows.withColumn(number, F.col(number) + start).withColumnRenamed(number, name)


def _between(df: DataFrame, start: int, end: int | None) -> DataFrame:
    """Rows from start up to end in the order of partitions, in that order."""
    rows, number, total = _numbered(df)
    start = max(0, start if start >= 0 else total + start)
    kept = rows.filter(F.col(number) >= start) if end is None else rows.filter(F.col(number).between(start, end - 1))
    return kept.orderBy(number).drop(number)


def offset(df: DataFrame, n: int) -> DataFrame:
    """All rows but the first n; stable only after a sort by a total order."""
    return df if n <= 0 else _between(df, n, None)


def slice_rows(df: DataFrame, start: int, count: int) -> DataFrame:
    """Rows start to start + count; stable only after a sort by a total order."""
    start, count = max(0, start), max(0, count)
    if start + count <= FEW:
        return df.offset(start).limit(count)
    return _between(df, start, start + count)


def tail(df: DataFrame, n: int = 5, keys=None) -> DataFrame:
    """The last n rows, in order. With the keys of the sort the reverse order is cut off; without, rows are numbered by their partitions. No task reads all rows."""
    if n <= 0:
        return df.limit(0)
    if keys is not None and n <= FEW:
        turned = [SortKey(k.name, not k.descending, not k.nulls_first_) for k in _keys(keys)]
        return df.orderBy(*(k.column() for k in turned)).limit(n).orderBy(*(k.column() for k in _keys(keys)))
    return _between(df if keys is None else sort(df, keys), -n, None)
