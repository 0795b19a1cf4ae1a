"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import SourceError


def shared_path(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. Without that setting a temporary folder serves local sessions; on a cluster the setting is required."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise SourceError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/brindle/{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its rows stay as they are, and executors may be lost. The table goes when the driver ends."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    gone = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(gone)
    return df.sparkSession.read.schema(df.schema).parquet(path)
