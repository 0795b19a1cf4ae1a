"""Helpers of the pipeline operators: the cluster's shared folder and tables cut off from their lineage."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import shared_path
from ..types import fresh_name


#: Rows and bytes of an Arrow batch at most. Texts are read whole, but workers hold few of them at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2048, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches to BATCH; smaller ones stay. Results do not depend on them, but the memory of long texts does."""
    for key, most in BATCH.items():
        now = spark.conf.get(key, None)
        if now is not None and not 0 < int(re.sub(r"\D", "", now) if now[:1] != "-" else 0) * _UNITS.get(now[-1:].lower(), 1) <= most:
            spark.conf.set(key, str(most))


_UNITS = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def values(column, step: int = 128):
    """The Python values of an Arrow column, of which only a few are held at a time: batches of long texts are large."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


_ROW_WISE = {"Project", "Filter", "SubqueryAlias", "View"}


def _of_one_scan(docs: DataFrame) -> bool:
    plan = docs._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.getClass().getSimpleName() in _ROW_WISE:
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation"


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column, and its name, that tells its rows apart and is the same on each evaluation, whatever the ids are.

    Rows of Parquet files are told apart by their file and place in it, which needs no copy; any other table is written first, numbered.
    """
    name = fresh_name(docs, "row_key")
    if _of_one_scan(docs):
        place = docs.metadataColumn("_metadata")
        try:
            keyed = docs.withColumn(name, F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row")))
        except AnalysisException:  # files of another format have no row numbers
            keyed = None
        if keyed is not None:
            return keyed, name
    number = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))
    return cut(docs.withColumn(name, number)), name


def without(keyed: DataFrame, name: str, rejected: DataFrame) -> DataFrame:
    """The rows of keyed (with_row_key's table and column) whose key is not in rejected (a column of that name), without the key."""
    bad = cut(rejected.select(F.col(name).alias("rejected")).select("rejected.file", "rejected.row"))
    key = keyed[name]
    return keyed.join(bad, (key["file"] == bad["file"]) & (key["row"] == bad["row"]), "left_anti").drop(name)


def cut(df: DataFrame) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: a lost executor costs no recomputation beyond this point. The table goes when the driver ends."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_path(spark)
    df.write.parquet(path)
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(gone)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    _written.append(path)
    return out


#: Tables of cut() that this process has written.
_written: list[str] = []


def cut_alone(spark: SparkSession, make) -> DataFrame:
    """cut(make()), after which all other tables that make() or its plan wrote are deleted."""
    before = len(_written)
    out = cut(make())
    for path in _written[before:]:
        if path != out._cut_path:
            _delete(spark, path)
    _written[before:] = [out._cut_path]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def drop_cut(df: DataFrame) -> None:
    """Deletes a table of cut() that no later plan reads."""
    _delete(df.sparkSession, df._cut_path)
