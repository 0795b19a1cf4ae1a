"""Date and time expressions in UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..errors import BrindleError
from .scalar import _col

#: Tokens of formats, the longest first, and what Spark calls them.
TOKENS = {"YYYY": "yyyy", "MMM": "MMM", "MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm", "ss": "ss", "SSS": "SSS"}
PERIODS = ("day", "week", "month", "quarter", "year")
_TOKEN = re.compile("YYYY|MMM|SSS|MM|DD|HH|mm|ss|[A-Za-z']+|[^A-Za-z']+")


def spark_format(pattern: str) -> str:
    """A format of YYYY MMM MM DD HH mm ss SSS as Spark writes it; other letters are literal."""
    return "".join(TOKENS.get(t) or (t if not re.search("[A-Za-z']", t) else "'" + t.replace("'", "''") + "'") for t in _TOKEN.findall(pattern))


def year(c) -> Column:
    return F.year(_col(c))


def month(c) -> Column:
    return F.month(_col(c))


def day(c) -> Column:
    return F.dayofmonth(_col(c))


def quarter(c) -> Column:
    return F.quarter(_col(c))


def hour(c) -> Column:
    return F.hour(_col(c))


def minute(c) -> Column:
    return F.minute(_col(c))


def second(c) -> Column:
    return F.second(_col(c))


def day_of_week(c) -> Column:
    """0 for Sunday to 6."""
    return F.dayofweek(_col(c)) - 1


def add_days(c, n: int) -> Column:
    return F.date_add(_col(c).cast("date"), n)


def sub_days(c, n: int) -> Column:
    return F.date_sub(_col(c).cast("date"), n)


def diff_days(a, b) -> Column:
    """Whole elapsed days from b to a, rounded down."""
    millis = lambda c: F.unix_millis(_col(c).cast("timestamp"))
    return F.floor((millis(a) - millis(b)) / 86_400_000)


def truncate_date(c, period: str) -> Column:
    """First date of the day, ISO week, month, quarter or year."""
    if period not in PERIODS:
        raise BrindleError(f"period is one of {PERIODS}, not {period!r}")
    return _col(c).cast("date") if period == "day" else F.trunc(_col(c), period)


def to_date(c, pattern: str | None = None) -> Column:
    """Null for text that is no date in the pattern."""
    return F.try_to_timestamp(_col(c), F.lit(spark_format(pattern))).cast("date") if pattern else _col(c).try_cast("date")


def to_timestamp(c, pattern: str | None = None) -> Column:
    return F.try_to_timestamp(_col(c), F.lit(spark_format(pattern))) if pattern else _col(c).try_cast("timestamp")


def format_date(c, pattern: str) -> Column:
    return F.date_format(_col(c), spark_format(pattern))
