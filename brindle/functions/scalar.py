"""Scalar expressions whose semantics differ from Spark's built-in functions of the same name. All stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce
from operator import and_ as _and, or_ as _or

from pyspark.sql import Column, functions as F, types as T

from ..types import spark_type


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _value(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def typed_lit(value, kind) -> Column:
    return F.lit(value).cast(spark_type(kind))


# predicates


def and_(*parts: Column) -> Column:
    return reduce(_and, parts, F.lit(True))


def or_(*parts: Column) -> Column:
    return reduce(_or, parts, F.lit(False))


def not_(part: Column) -> Column:
    """Two-valued: true where part is false or null."""
    return ~F.coalesce(part, F.lit(False))


def is_in(column, values) -> Column:
    """Set membership; a null matches only if values holds None."""
    c, known = _col(column), [v for v in values if v is not None]
    found = c.isin(known) if known else F.lit(False)
    return found | c.isNull() if len(known) < len(list(values)) else found


def between(column, low, high) -> Column:
    return _col(column).between(low, high)


# arithmetic: null instead of an error for overflow and division by zero


def add(a, b) -> Column:
    return F.try_add(_col(a), _value(b))


def sub(a, b) -> Column:
    return F.try_subtract(_col(a), _value(b))


def mul(a, b) -> Column:
    return F.try_multiply(_col(a), _value(b))


def div(a, b) -> Column:
    """True division in double precision; null for a zero divisor."""
    return F.try_divide(_col(a).cast("double"), _value(b).cast("double"))


def int_div(a, b) -> Column:
    """Quotient of 64-bit integers, truncated towards zero; null for a zero divisor."""
    x, y = _col(a).cast("long"), F.nullif(_value(b).cast("long"), F.lit(0).cast("long"))
    return F.call_function("div", x, y)


def mod(a, b) -> Column:
    """Remainder with the sign of the dividend; null for a zero divisor."""
    return F.try_mod(_col(a), _value(b))


def neg(a) -> Column:
    return -_col(a)


def round_half_up(a, digits: int = 0) -> Column:
    """Halves go towards plus infinity: -2.5 becomes -2."""
    scale = 10.0**digits
    return F.floor(_col(a).cast("double") * scale + 0.5).cast("double") / scale


def floor(a) -> Column:
    return F.floor(_col(a).cast("double")).cast("double")


def ceil(a) -> Column:
    return F.ceil(_col(a).cast("double")).cast("double")


def abs_(a) -> Column:
    return F.abs(_col(a).cast("double"))


def sqrt(a) -> Column:
    """NaN for negative numbers."""
    return F.sqrt(_col(a).cast("double"))


def pow_(a, exponent) -> Column:
    return F.pow(_col(a).cast("double"), _value(exponent).cast("double"))


# conditions


def coalesce(*values) -> Column:
    return F.coalesce(*(v if isinstance(v, Column) else F.col(v) for v in values))


class When:
    """when(c, v).when(...).otherwise(x); an otherwise is required."""

    def __init__(self, branches) -> None:
        self._branches = branches

    def when(self, condition: Column, value) -> When:
        return When([*self._branches, (condition, value)])

    def otherwise(self, value) -> Column:
        (c, v), *rest = self._branches
        out = F.when(c, _value(v))
        for c, v in rest:
            out = out.when(c, _value(v))
        return out.otherwise(_value(value))


def when(condition: Column, value) -> When:
    return When([(condition, value)])


# casts: null for what cannot be converted

TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y", "on"), ("false", "0", "no", "n", "off")


def cast_to(column, kind, source: T.DataType | None = None) -> Column:
    """column as kind, null where it cannot be.

    source, the column's type, is needed for text and fractional sources of integers: these are truncated towards zero.
    """
    c, target = _col(column), spark_type(kind)
    if isinstance(target, T.BooleanType) and isinstance(source, T.StringType):
        word = F.lower(trim(c))
        return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))
    if isinstance(source, T.StringType) and isinstance(target, T.NumericType):
        c = trim(c)
        if isinstance(target, (T.IntegralType, T.DecimalType)):
            whole, number = c.try_cast(target), c.try_cast("double")
            return F.coalesce(whole, F.when(~F.isnan(number), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))).try_cast(target))
    if isinstance(target, T.IntegralType) and isinstance(source, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c).try_cast(target)
    return c.try_cast(target)


# text


def length(column) -> Column:
    """Code points."""
    return F.length(_col(column))


def substring(column, start: int, count: int | None = None) -> Column:
    """From position start, counted from 0; to the end without a count."""
    return F.substring(_col(column), start + 1, 2**31 - 1 if count is None else count)


def upper(column) -> Column:
    return F.upper(_col(column))


def lower(column) -> Column:
    return F.lower(_col(column))


#: White space of Unicode, and the byte order mark, as a class of a regular expression.
WHITE = r"[\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def trim(column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_col(column), f"^{WHITE}+|{WHITE}+$", "")


def replace(column, pattern: str, replacement: str, all_: bool = True) -> Column:
    """Literal text replaced everywhere, or at its first place. An empty pattern changes nothing."""
    c = _col(column)
    if not pattern:
        return c
    if all_:
        return F.replace(c, F.lit(pattern), F.lit(replacement))
    at = F.instr(c, pattern)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(replacement), F.substring(c, at + len(pattern), F.lit(2**31 - 1)))).otherwise(c)


def pad(column, width: int, fill: str = " ", side: str = "left") -> Column:
    """Padded to width; longer text stays whole."""
    c = _col(column)
    return F.when(F.length(c) < width, (F.lpad if side == "left" else F.rpad)(c, width, fill)).otherwise(c)


def substring_range(column, start: int, end: int) -> Column:
    """Positions start to end, end exclusive, counted from 0."""
    return F.substring(_col(column), start + 1, max(0, end - start))


def contains(column, text: str) -> Column:
    return _col(column).contains(text)


def starts_with(column, text: str) -> Column:
    return _col(column).startswith(text)


def ends_with(column, text: str) -> Column:
    return _col(column).endswith(text)


def like(column, pattern: str) -> Column:
    return _col(column).like(pattern)


def regexp_match(column, pattern: str) -> Column:
    return _col(column).rlike(pattern)


def concat(*columns) -> Column:
    return F.concat(*map(_col, columns))


def code_points(column) -> Column:
    return F.length(_col(column))


def byte_length(column) -> Column:
    return F.octet_length(_col(column))


def index_of(column, text: str) -> Column:
    """Position of the first occurrence from 0, or -1."""
    return F.instr(_col(column), text) - 1


def parse_json(column) -> Column:
    """Compact text of valid JSON with sorted keys; null for JSON null and invalid text."""
    c = F.try_parse_json(_col(column)).cast("string")
    return F.when(c != "null", c)
