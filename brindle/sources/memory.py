"""Frames from values on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..errors import BrindleError, SchemaError
from ..types import make_schema


def _schema(schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else make_schema(schema)


def from_records(spark: SparkSession, rows: list[dict], schema) -> DataFrame:
    """Rows as dicts; missing fields are null."""
    s = _schema(schema)
    return spark.createDataFrame([tuple(r.get(n) for n in s.fieldNames()) for r in rows], s)


def from_columns(spark: SparkSession, columns: dict[str, list], schema=None) -> DataFrame:
    """Columns of one length; without a schema, types come from the values."""
    if not columns:
        raise SchemaError("a frame needs a column")
    if len({len(v) for v in columns.values()}) > 1:
        raise BrindleError(f"columns differ in length: {({k: len(v) for k, v in columns.items()})}")
    if schema is not None:
        s = _schema(schema)
        return spark.createDataFrame(list(zip(*(columns[n] for n in s.fieldNames()))), s)
    return spark.createDataFrame(pa.table({k: pa.array(v) for k, v in columns.items()}))


from_arrays = from_columns


def range_frame(spark: SparkSession, start: float, end: float, step: float = 1, name: str = "value") -> DataFrame:
    """start, start + step, ... before end, as doubles; made in the executors."""
    if step == 0:
        raise BrindleError("a step is not 0")
    n = max(0, -int(-((end - start) / step) // 1))
    return spark.range(n).select((F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias(name))


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], _schema(schema))


def from_batches(spark: SparkSession, batches) -> DataFrame:
    """Arrow batches or a table."""
    return spark.createDataFrame(batches if isinstance(batches, pa.Table) else pa.Table.from_batches(list(batches)))
