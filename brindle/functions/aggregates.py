"""Aggregates; all skip nulls and give null for groups without a value, but counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalar import _col


def sum_(c) -> Column:
    return F.sum(_col(c).cast("double"))


def avg(c) -> Column:
    return F.avg(_col(c).cast("double"))


mean = avg


def count(c=None) -> Column:
    """Non-null values of c, or all rows."""
    return F.count(F.lit(1)) if c is None else F.count(_col(c))


def min_(c) -> Column:
    return F.min(_col(c))


def max_(c) -> Column:
    return F.max(_col(c))


def first(c, order=None) -> Column:
    """First non-null value by order; without an order any one, as rows have none."""
    return F.first(_col(c), ignorenulls=True) if order is None else F.min_by(_col(c), F.when(_col(c).isNotNull(), _col(order)))


def last(c, order=None) -> Column:
    return F.last(_col(c), ignorenulls=True) if order is None else F.max_by(_col(c), F.when(_col(c).isNotNull(), _col(order)))


def std(c) -> Column:
    """Of a sample; null for fewer than two values."""
    return F.stddev_samp(_col(c).cast("double"))


def variance(c) -> Column:
    return F.var_samp(_col(c).cast("double"))


def median(c) -> Column:
    """Exact; the mean of the middle two. A task holds a group's distinct values: operators.median does without, for large groups."""
    return F.median(_col(c).cast("double"))


def approx_median(c, accuracy: int = 10_000) -> Column:
    """In bounded memory per group, for groups whose distinct values do not fit in a task."""
    return F.percentile_approx(_col(c).cast("double"), 0.5, accuracy)


def count_distinct(c) -> Column:
    return F.count_distinct(_col(c))


def count_unique(c) -> Column:
    """Distinct values, null counted as one."""
    return F.count_distinct(_col(c)) + F.coalesce(F.max(_col(c).isNull().cast("long")), F.lit(0))
