"""Appending, union and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..errors import SchemaError
from ..types import fresh_name
from .order import SortKey
from .rows import _known


def validate_same_columns(a: DataFrame, b: DataFrame) -> None:
    """Raises SchemaError unless both have the same names and types in the same order."""
    left, right = ([(f.name, f.dataType) for f in df.schema] for df in (a, b))
    if left != right:
        raise SchemaError(f"columns differ: {a.schema.simpleString()} and {b.schema.simpleString()}")


def concat(df: DataFrame, other: DataFrame) -> DataFrame:
    """The rows of both, repeated ones too."""
    validate_same_columns(df, other)
    return df.union(other)


union_all = concat


def union(df: DataFrame, other: DataFrame) -> DataFrame:
    """The distinct rows of both."""
    return concat(df, other).distinct()


def unique(df: DataFrame, columns: list[str] | None = None, order=None, keep: str = "first") -> DataFrame:
    """One row for each combination of columns, nulls equal: the first or last by order. Without an order any row of a combination, cheaply."""
    if columns is None:
        return df.distinct()
    _known(df, columns)
    if order is None:
        return df.dropDuplicates(columns)
    keys = [SortKey(k) if isinstance(k, str) else k for k in (order if isinstance(order, (list, tuple)) else [order])]
    if keep == "last":
        keys = [SortKey(k.name, not k.descending, not k.nulls_first_) for k in keys]
    w = Window.partitionBy(*columns).orderBy(*(k.column() for k in keys))
    row = fresh_name(df, "row")
    return df.withColumn(row, F.row_number().over(w)).filter(F.col(row) == 1).drop(row)


def drop_duplicates(df: DataFrame, columns: list[str] | None = None, order=None, keep: str = "first") -> DataFrame:
    return unique(df, columns, order, keep)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()
