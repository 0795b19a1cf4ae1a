"""What an expression is, as far as the analyser knows it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, SparkSession, types as T

from ..errors import TypeMismatch


def infer_type(spark: SparkSession, expression: Column, schema: T.StructType) -> T.DataType:
    return spark.createDataFrame([], schema).select(expression.alias("e")).schema["e"].dataType


def validate(spark: SparkSession, expression: Column, schema: T.StructType) -> None:
    try:
        infer_type(spark, expression, schema)
    except AnalysisException as e:
        raise TypeMismatch(str(e)) from e


def is_predicate(spark: SparkSession, expression: Column, schema: T.StructType) -> bool:
    return isinstance(infer_type(spark, expression, schema), T.BooleanType)


def is_aggregate(spark: SparkSession, expression: Column, schema: T.StructType) -> bool:
    plan = spark.createDataFrame([], schema).select(expression)._jdf.queryExecution().analyzed().toString()
    return plan.startswith("Aggregate")


def format_expression(expression: Column, spark: SparkSession | None = None, schema: T.StructType | None = None) -> str:
    """The expression as text: as it was written, or with a session and a schema as the analyser names it."""
    if spark is not None and schema is not None:
        return spark.createDataFrame([], schema).select(expression).columns[0]
    return str(expression)[len("Column<'") : -2]


def pushed_filters(df) -> str:
    """The filters that the scans of a frame take over, from its plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "; ".join(p.split("]")[0] + "]" for p in plan.split("PushedFilters: ")[1:])
