"""Expressions: scalar, dates and aggregates."""

from pyspark.sql.functions import col, lit

from .aggregates import approx_median, avg, count, count_distinct, count_unique, first, last, max_, mean, median, min_, std, sum_, variance
from .dates import add_days, day, day_of_week, diff_days, format_date, hour, minute, month, quarter, second, spark_format, sub_days, to_date, to_timestamp, truncate_date, year
from .scalar import (
    abs_, add, and_, between, byte_length, cast_to, ceil, coalesce, code_points, concat, contains, div, ends_with, floor, index_of, int_div, is_in, length, like, lower, mod, mul, neg, not_,
    or_, pad, parse_json, pow_, regexp_match, replace, round_half_up, sqrt, starts_with, sub, substring, substring_range, trim, typed_lit, upper, when,
)

__all__ = [n for n in dir() if not n.startswith("__")]
