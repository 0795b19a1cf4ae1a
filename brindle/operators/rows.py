"""Projection, filters, cleaning and row-order operators: functions from DataFrame to DataFrame, for df.transform."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import BrindleError, ColumnError, SchemaError
from ..functions.scalar import cast_to, replace, trim
from ..storage import materialised
from ..types import fresh_name, get_column


def _known(df: DataFrame, names) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ColumnError(f"no column {missing}; there are {df.columns}")


def select(df: DataFrame, *items: str | Column) -> DataFrame:
    """Columns in the given order; names must exist and not repeat. Expressions are allowed."""
    names = [i for i in items if isinstance(i, str)]
    _known(df, names)
    if len(set(names)) < len(names) or not items:
        raise SchemaError("columns must be given once, and at least one")
    return df.select(*items)


def drop(df: DataFrame, *names: str) -> DataFrame:
    """Without the named columns; unknown names are ignored, one column must be left."""
    if set(df.columns) <= set(names):
        raise SchemaError("no column would be left")
    return df.drop(*names)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """New names; unknown ones are ignored, collisions raise."""
    out = [names.get(c, c) for c in df.columns]
    if len(set(out)) < len(out):
        raise SchemaError(f"columns would share a name: {out}")
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def select_as(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns by new name: {new: old}."""
    _known(df, names.values())
    return df.select(*(F.col(old).alias(new) for new, old in names.items()))


def filter_rows(df: DataFrame, predicate: Column | Callable) -> DataFrame:
    """Rows whose predicate is true. A callable gets pandas batches and returns a mask, for what expressions cannot say."""
    if isinstance(predicate, Column):
        return df.filter(predicate)

    def run(batches):
        for b in batches:
            yield b[predicate(b)]

    return df.mapInPandas(run, df.schema)


where = filter_rows


def with_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def with_columns(df: DataFrame, values: dict[str, Column] | list[tuple[str, Column]]) -> DataFrame:
    """All values see the input's columns only."""
    return df.withColumns(dict(values))


def cast(df: DataFrame, name: str, kind) -> DataFrame:
    return df.withColumn(name, cast_to(name, kind, get_column(df.schema, name).dataType))


def fill_null(df: DataFrame, name: str, value) -> DataFrame:
    """value: a constant, or an expression over the row's columns."""
    return fill_nulls(df, {name: value})


def fill_nulls(df: DataFrame, values: dict) -> DataFrame:
    """Constants or expressions by column; expressions see the input's columns."""
    _known(df, values)
    return df.withColumns({c: F.coalesce(F.col(c), (v if isinstance(v, Column) else F.lit(v)).cast(df.schema[c].dataType)) for c, v in values.items()})


def drop_null(df: DataFrame, columns: list[str] | None = None, how: str = "any") -> DataFrame:
    if columns:
        _known(df, columns)
    return df.dropna(how, subset=columns or None)


def count_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: the nulls of each column."""
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns or df.columns))


def has_any_null(df: DataFrame, columns: list[str] | None = None) -> bool:
    held = [F.col(c).isNull() for c in columns or df.columns]
    found = held[0]
    for h in held[1:]:
        found = found | h
    return not df.filter(found).isEmpty()



def _fill(df: DataFrame, name: str, order, by, forward: bool, split: bool) -> DataFrame:
    _known(df, [name])
    by = [by] if isinstance(by, str) else list(by or [])
    order = [order] if isinstance(order, (str, Column)) else list(order)
    if not order:
        raise BrindleError("rows have no order of their own: name order columns")
    if by and not split:
        at, kept = (fresh_name(df, n) for n in ("at", "kept"))
        return _known_values(df, name, order, by, forward, at, kept).withColumn(name, F.col(kept)).select(*df.columns)
    return _fill_ranges(df, name, order, by, forward)


def _known_values(df: DataFrame, name: str, order: list, by: list, forward: bool, at: str, kept: str) -> DataFrame:
    """df with the number of each row in its group, at, and the nearest value at or before it, or at or after it, kept.

    Spark reads a frame up to the last row anew for each row, which takes the square of a group's rows: backwards the rows are turned, and the frame starts at the first.
    """
    numbered = df.withColumn(at, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    w = Window.partitionBy(*by).orderBy(*(order if forward else [F.desc(at)]))
    return numbered.withColumn(kept, F.last(name, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _fill_ranges(df: DataFrame, name: str, order: list, by: list[str], forward: bool) -> DataFrame:
    """A group may be large, or all rows one group: range partitions are filled each on their own. What one hands to the next is a value for each group that it holds."""
    part, at, kept = (fresh_name(df, n) for n in ("part", "at", "kept"))
    parts = df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id())
    # written, as the partitions of a row must not change between the two uses
    numbered = materialised(_known_values(parts, name, order, [part, *by], forward, at, kept))
    value = F.when(F.col(name).isNotNull(), F.col(at))
    groups = [F.col(c).alias(f"by_{i}") for i, c in enumerate(by)]
    ends = numbered.groupBy(F.col(part).alias("of"), *groups).agg((F.max_by if forward else F.min_by)(name, value).alias("v"))
    over_parts = Window.partitionBy(*(f"by_{i}" for i in range(len(by)))).orderBy("of" if forward else F.desc("of"))
    carried = F.last("v", True).over(over_parts.rowsBetween(Window.unboundedPreceding, -1))
    edges = ends.withColumn("carried", carried).filter("carried is not null").select(F.struct("*").alias(found := fresh_name(numbered, "found")))
    on = numbered[part] == edges[found]["of"]
    for i, c in enumerate(by):
        on = on & numbered[c].eqNullSafe(edges[found][f"by_{i}"])
    return numbered.join(edges, on, "left").withColumn(name, F.coalesce(F.col(kept), F.col(found)["carried"])).select(*df.columns)


def fill_forward(df: DataFrame, name: str, order, by: list[str] | str | None = None, split_groups: bool = True) -> DataFrame:
    """Nulls take the previous value in order, inside groups if by is given; leading nulls stay. order must be total within a group.

    Groups are spread over tasks, as one may hold a large share of all rows; split_groups=False saves a written table where all groups are small. Without groups rows are always spread.
    """
    return _fill(df, name, order, by, True, split_groups)


def fill_backward(df: DataFrame, name: str, order, by: list[str] | str | None = None, split_groups: bool = True) -> DataFrame:
    return _fill(df, name, order, by, False, split_groups)


def shuffle(df: DataFrame, seed: int | None = None) -> DataFrame:
    return df.orderBy(F.rand(seed))


def sample(df: DataFrame, fraction: float, seed: int | None = None, key: str | None = None) -> DataFrame:
    """Each row with that probability; none for 0 or less, all for 1 or more.

    With a key the choice is the key's: rows whose MD5 of "key:seed" is in the lowest fraction of 32 bits, whatever the partitions are; null keys are left out.
    """
    if fraction <= 0:
        return df.filter(F.lit(False))
    if fraction >= 1:
        return df
    if key is None:
        return df.sample(fraction=fraction, seed=seed)
    _known(df, [key])
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{0 if seed is None else seed}")))
    return df.filter(F.substring(digest, 1, 8) < f"{int(fraction * 2**32):08x}")


def explode_json(df: DataFrame, name: str) -> DataFrame:
    """Text of JSON arrays gives a row for each item, as text; other text stays, null too; an empty array gives no row. Array columns are exploded."""
    kind = get_column(df.schema, name).dataType.typeName()
    items = F.col(name) if kind == "array" else F.coalesce(F.from_json(name, "array<string>"), F.array(name))
    return df.withColumn(name, F.explode(items))


def trim_column(df: DataFrame, name: str) -> DataFrame:
    _known(df, [name])
    return df.withColumn(name, trim(name))


def replace_column(df: DataFrame, name: str, pattern: str, replacement: str, all_: bool = True) -> DataFrame:
    _known(df, [name])
    return df.withColumn(name, replace(name, pattern, replacement, all_))
