"""A pipeline without data: steps are collected, checked against a schema when built, and applied to any frame."""

from __future__ import annotations

from dataclasses import dataclass, field
from time import perf_counter

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from .. import operators as O
from ..types import make_schema


@dataclass(frozen=True)
class Pipeline:
    """Steps from a schema on; each method returns a new pipeline, errors show at build()."""

    schema: T.StructType
    steps: tuple = field(default=())

    def _then(self, fn, *args) -> Pipeline:
        return Pipeline(self.schema, (*self.steps, (fn, args)))

    def filter(self, predicate: Column) -> Pipeline:
        return self._then(O.filter_rows, predicate)

    def select(self, *names: str) -> Pipeline:
        return self._then(O.select, *names)

    def select_as(self, names: dict[str, str]) -> Pipeline:
        return self._then(O.select_as, names)

    def add_column(self, name: str, value: Column) -> Pipeline:
        return self._then(O.with_column, name, value)

    def with_columns(self, values: dict[str, Column]) -> Pipeline:
        return self._then(O.with_columns, values)

    def limit(self, n: int, offset: int = 0) -> Pipeline:
        """n rows after the first offset ones."""
        return self._then(O.slice_rows, offset, n) if offset else self._then(O.limit, n)

    def sort(self, *keys) -> Pipeline:
        return self._then(O.sort, *keys)

    def aggregate(self, specs) -> Pipeline:
        return self._then(O.aggregate, specs)

    def group_by(self, keys, specs) -> Pipeline:
        return self._then(O.group_by, keys, specs)

    def build(self, spark):
        """A function for df.transform; raises the first error of a step."""
        self.apply(spark.createDataFrame([], self.schema))
        return self.apply

    def apply(self, df: DataFrame) -> DataFrame:
        for fn, args in self.steps:
            df = fn(df, *args)
        return df

    def execute(self, df: DataFrame) -> dict:
        """The result's rows with counts and time: for small results, which reach the driver. Rows of the input are counted as the same job reads them."""
        began, seen = perf_counter(), Observation()
        rows = self.apply(df.observe(seen, F.count(F.lit(1)).alias("n"))).collect()
        return {"rows": rows, "rows_in": seen.get["n"], "rows_out": len(rows), "seconds": perf_counter() - began}


def from_schema(schema) -> Pipeline:
    return Pipeline(schema if isinstance(schema, T.StructType) else make_schema(schema))
