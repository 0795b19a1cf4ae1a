"""Text operators on columns and rows. Text compares by its UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as E
from .rows import _known


def _changed(df: DataFrame, name: str, value: Column) -> DataFrame:
    _known(df, [name])
    return df.withColumn(name, value)


def upper_column(df: DataFrame, name: str) -> DataFrame:
    return _changed(df, name, F.upper(name))


def lower_column(df: DataFrame, name: str) -> DataFrame:
    return _changed(df, name, F.lower(name))


def substring_column(df: DataFrame, name: str, start: int, end: int) -> DataFrame:
    """Positions start to end, end exclusive, counted from 0."""
    return _changed(df, name, E.substring_range(name, start, end))


def pad_column(df: DataFrame, name: str, width: int, fill: str = " ", side: str = "left") -> DataFrame:
    return _changed(df, name, E.pad(name, width, fill, side))


def filter_by_prefix(df: DataFrame, name: str, prefix: str) -> DataFrame:
    return df.filter(F.col(name).startswith(prefix))


def filter_by_suffix(df: DataFrame, name: str, suffix: str) -> DataFrame:
    return df.filter(F.col(name).endswith(suffix))


def filter_by_char_length(df: DataFrame, name: str, low: int = 0, high: int = 2**31 - 1) -> DataFrame:
    return df.filter(F.length(name).between(low, high))


def filter_by_byte_length(df: DataFrame, name: str, low: int = 0, high: int = 2**31 - 1) -> DataFrame:
    return df.filter(F.octet_length(name).between(low, high))


def compare(a, b) -> Column:
    """-1, 0 or 1 by the bytes of a and b; null if either is null."""
    x, y = E._col(a), E._col(b)
    return F.when(x < y, -1).when(x == y, 0).when(x > y, 1)


def offset_of_code_point(column, n: int) -> Column:
    """Bytes before code point n, counted from 0."""
    return F.octet_length(F.substring(E._col(column), 1, n))
