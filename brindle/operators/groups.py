"""Grouped and whole-table aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..errors import BrindleError, SchemaError
from ..functions import aggregates as A
from ..storage import materialised
from ..types import fresh_name
from .rows import _known


def _named(specs) -> list[Column]:
    pairs = list(specs.items()) if isinstance(specs, dict) else [(s["name"], s["expr"]) if isinstance(s, dict) else s for s in specs]
    names = [n for n, _ in pairs]
    if not pairs or len(set(names)) < len(names):
        raise SchemaError(f"aggregates need different names, one at least: {names}")
    return [e.alias(n) for n, e in pairs]


def aggregate(df: DataFrame, specs) -> DataFrame:
    """One row. specs: {name: aggregate} or pairs; aggregates may hold any expression."""
    return df.agg(*_named(specs))


class Grouped:
    """Rows grouped by keys; null keys form a group of their own."""

    def __init__(self, df: DataFrame, keys: list[str]) -> None:
        if not keys:
            raise BrindleError("groups need a key")
        _known(df, keys)
        self._groups, self._keys = df.groupBy(*keys), keys

    def agg(self, specs) -> DataFrame:
        return self._groups.agg(*_named(specs))

    def count(self) -> DataFrame:
        return self._groups.agg(A.count().alias("count"))

    def min(self, c: str) -> DataFrame:
        return self._groups.agg(A.min_(c).alias(f"min({c})"))

    def max(self, c: str) -> DataFrame:
        return self._groups.agg(A.max_(c).alias(f"max({c})"))

    def mean(self, c: str) -> DataFrame:
        return self._groups.agg(A.avg(c).alias(f"mean({c})"))

    def sum(self, c: str) -> DataFrame:
        return self._groups.agg(A.sum_(c).alias(f"sum({c})"))

    def pivot(self, column: str, values: list, aggregate: Column) -> DataFrame:
        """A column for each of the values, which are named so that no extra pass looks for them."""
        return self._groups.pivot(column, values).agg(aggregate)


def group_by(df: DataFrame, keys: str | list[str], specs=None) -> Grouped | DataFrame:
    grouped = Grouped(df, [keys] if isinstance(keys, str) else list(keys))
    return grouped if specs is None else grouped.agg(specs)


def scalar_min(df: DataFrame, c: str):
    return df.agg(F.min(c)).first()[0]


def scalar_max(df: DataFrame, c: str):
    return df.agg(F.max(c)).first()[0]


def scalar_mean(df: DataFrame, c: str):
    return df.agg(A.avg(c)).first()[0]


def scalars(df: DataFrame, specs) -> dict:
    """The values of several whole-table aggregates by name, in one pass."""
    return aggregate(df, specs).first().asDict()


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each column (default: all numeric ones): column, count (non-null), nulls, mean, std, min, max in double. One pass."""
    names = list(columns) or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    _known(df, names)
    if not names:
        raise SchemaError("no numeric column")
    v = lambda c: F.col(c).cast("double")
    parts = lambda c: (F.lit(c).alias("column"), F.count(v(c)).alias("count"), F.count_if(v(c).isNull()).alias("nulls"), F.avg(v(c)).alias("mean"), F.stddev_samp(v(c)).alias("std"), F.min(v(c)).alias("min"), F.max(v(c)).alias("max"))
    return df.agg(F.array(*(F.struct(*parts(c)) for c in names)).alias("all")).select(F.explode("all").alias("one")).select("one.*")


def median(df: DataFrame, c: str, keys: str | list[str] = ()) -> DataFrame:
    """keys and median: exact, the mean of the middle two, for groups of any size; null for groups without a value.

    Equal values are counted before the shuffle. Range partitions of the sorted values then count on their own, and only their sums for each group are added up, so that no task holds a group.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    _known(df, [c, *keys])
    by = [f"by_{i}" for i in range(len(keys))]
    plain = df.select(*(F.col(k).alias(b) for k, b in zip(keys, by)), F.col(c).cast("double").alias("v"))
    counts = plain.filter("v is not null").groupBy(*by, "v").agg(F.count("*").alias("n"))
    kept = materialised(counts.repartitionByRange(*by, "v").withColumn("part", F.spark_partition_id()))
    sums = kept.groupBy("part", *by).agg(F.sum("n").alias("all"))
    w = Window.partitionBy(*by)
    before = sums.withColumn("before", F.sum("all").over(w.orderBy("part")) - F.col("all")).withColumn("total", F.sum("all").over(w)).select("part", *(F.col(b).alias(f"of_{b}") for b in by), "before", "total")
    on = kept["part"] == before["part"]
    for b in by:
        on = on & kept[b].eqNullSafe(before[f"of_{b}"])
    upto = kept.join(before, on).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(kept["part"], *by).orderBy("v")))
    # the middle ranks, from 1, that each run of equal values covers
    held = lambda rank: ((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)).cast("double")
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    middle = upto.withColumn("share", (held(low) + held(high)) / 2).filter("share > 0").groupBy(*by).agg(F.sum(F.col("v") * F.col("share")).alias("median"))
    if not by:
        return middle
    groups = plain.select(*by).distinct()
    on = [groups[b].eqNullSafe(middle[b]) for b in by]
    return groups.join(middle, on, "left").select(*(groups[b].alias(k) for b, k in zip(by, keys)), "median")


def top_per_group(df: DataFrame, keys: list[str], order, n: int) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle."""
    order = order if isinstance(order, (list, tuple)) else [order]
    rank = fresh_name(df, "rank")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n).drop(rank)
