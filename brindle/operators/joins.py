"""Equi-joins with a rule for names: left columns, then right ones; a key of one name stands once, other clashes get a suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import BrindleError, SchemaError
from .rows import _known

HOW = ("inner", "left", "right", "full", "semi", "anti", "cross")


def _renamed(left: DataFrame, right: DataFrame, shared: set[str], suffix: str) -> DataFrame:
    taken = set(left.columns)
    new = {c: c + suffix for c in right.columns if c in taken and c not in shared}
    names = [c for c in left.columns] + [new.get(c, c) for c in right.columns if c not in shared]
    if len(set(names)) < len(names):
        raise SchemaError(f"columns would share a name even with suffix {suffix!r}: {names}")
    return right.withColumnsRenamed(new)


def join(left: DataFrame, right: DataFrame, left_on, right_on=None, how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Rows joined on one key or several; null keys never match.

    Spark picks the strategy: small sides are broadcast by their measured size, large ones sorted and merged, hot keys split by adaptive execution. Keys that have one name on both sides stand
    once, and hold the key of whichever side there is.
    """
    if how not in HOW:
        raise BrindleError(f"how is one of {HOW}, not {how!r}")
    if how == "cross":
        return cross_join(left, right, suffix)
    lk = [left_on] if isinstance(left_on, str) else list(left_on)
    rk = lk if right_on is None else [right_on] if isinstance(right_on, str) else list(right_on)
    if len(lk) != len(rk) or not lk:
        raise BrindleError("both sides need the same number of keys, one at least")
    _known(left, lk)
    _known(right, rk)
    marked = right.select(*(F.col(f"`{c}`").alias(f"_r_{i}") for i, c in enumerate(right.columns)))
    at = {c: f"_r_{i}" for i, c in enumerate(right.columns)}
    on = None
    for a, b in zip(lk, rk):
        part = left[a] == marked[at[b]]
        on = part if on is None else on & part
    if how in ("semi", "anti"):
        return left.join(marked, on, f"left_{how}")
    shared = {a for a, b in zip(lk, rk) if a == b}
    named = _renamed(left, right, shared, suffix)
    kept = [F.coalesce(left[c], marked[at[c]]).alias(c) if c in shared and how in ("right", "full") else left[c] for c in left.columns]
    added = [marked[at[old]].alias(new) for old, new in zip(right.columns, named.columns) if old not in shared]
    return left.join(marked, on, how).select(*kept, *added)


def inner_join(left: DataFrame, right: DataFrame, left_on, right_on=None, suffix: str = "_right") -> DataFrame:
    return join(left, right, left_on, right_on, "inner", suffix)


def left_join(left: DataFrame, right: DataFrame, left_on, right_on=None, suffix: str = "_right") -> DataFrame:
    return join(left, right, left_on, right_on, "left", suffix)


def right_join(left: DataFrame, right: DataFrame, left_on, right_on=None, suffix: str = "_right") -> DataFrame:
    return join(left, right, left_on, right_on, "right", suffix)


def full_join(left: DataFrame, right: DataFrame, left_on, right_on=None, suffix: str = "_right") -> DataFrame:
    return join(left, right, left_on, right_on, "full", suffix)


def semi_join(left: DataFrame, right: DataFrame, on, right_on=None) -> DataFrame:
    """Left rows with a match, each once."""
    return join(left, right, on, right_on, "semi")


def anti_join(left: DataFrame, right: DataFrame, on, right_on=None) -> DataFrame:
    """Left rows without a match; rows with a null key are kept."""
    return join(left, right, on, right_on, "anti")


def cross_join(left: DataFrame, right: DataFrame, suffix: str = "_right") -> DataFrame:
    return left.crossJoin(_renamed(left, right, set(), suffix))
