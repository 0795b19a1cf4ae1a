"""CSV with a given schema. Columns bind by position; files are split among tasks unless a quoted value may hold line ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..errors import SourceError
from ..types import UNSIGNED, fresh_name, make_schema, spark_type
from .parquet import cached_read

#: White space and control characters, which do not count at the ends of a value.
SPACE = "".join(map(chr, range(33)))


def _raw_schema(schema: T.StructType, defaults: bool) -> T.StructType:
    """What the reader itself parses: numbers, unless empty and malformed ones must be told apart; all else as text."""
    native = lambda t: isinstance(t, T.NumericType) and not defaults
    return T.StructType([T.StructField(f.name, f.dataType if native(f.dataType) else T.StringType()) for f in schema])


def _typed(frame: DataFrame, schema: T.StructType, defaults: bool) -> DataFrame:
    """Raw columns as their kinds: trimmed; empty is null, or with defaults the kind's default; what does not parse is null."""
    out = []
    for f in schema:
        target, most = spark_type(f.dataType), UNSIGNED.get(f.metadata.get("kind"))
        if frame.schema[f.name].dataType == target and isinstance(target, T.NumericType):
            value = F.col(f"`{f.name}`")
            out.append((value if most is None else F.when(value.between(0, F.lit(most).cast(target)), value)).alias(f.name))
            continue
        raw = F.btrim(F.col(f"`{f.name}`"), F.lit(SPACE))
        empty = raw.isNull() | (raw == "")
        if isinstance(target, T.BooleanType):
            value = F.when(~empty, F.substring(raw, 1, 1).isin("1", "T", "t", "Y", "y"))
            missing = F.lit(False)
        elif isinstance(target, T.StringType):
            value, missing = F.when(~empty, raw), F.lit("")
        elif isinstance(target, T.NumericType):
            value, missing = raw.try_cast(target), F.lit(0).cast(target)
            if most is not None:
                value = F.when(value.between(0, F.lit(most).cast(target)), value)
        else:
            value, missing = raw.try_cast(target), F.lit(None).cast(target)
        out.append((F.when(empty, missing).otherwise(value) if defaults else value).alias(f.name))
    return frame.select(*out)


def _options(delimiter: str, quote: str, header: bool, multi_line: bool) -> dict:
    return {"sep": delimiter, "quote": quote, "escape": quote, "header": str(header).lower(), "multiLine": str(multi_line).lower(), "mode": "PERMISSIVE", "enforceSchema": "true", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}


def read_csv(
    spark: SparkSession, path, schema, delimiter: str = ",", quote: str = '"', header: bool = True, skip_rows: int = 0, max_rows: int | None = None, projection: list[int] | None = None,
    filter: Column | None = None, defaults: bool = False, multi_line: bool = False, cache_dir: str | None = None,
) -> DataFrame:
    """A CSV file or folder, lazily. skip_rows: data rows left out at the start, in file order; projection: ordinals of the columns to keep. Unused columns are not parsed.

    cache_dir: the parsed file is kept there as Parquet, and later reads with the same schema and options come from it until the file changes.
    """
    s = schema if isinstance(schema, T.StructType) else make_schema(schema)
    if cache_dir is not None:
        whole = lambda: read_csv(spark, path, s, delimiter, quote, header, skip_rows, defaults=defaults, multi_line=multi_line)
        out = cached_read(spark, path, whole, cache_dir, repr((s.json(), delimiter, quote, header, skip_rows, defaults, multi_line)))
        if projection is not None:
            out = out.select(*(s[i].name for i in projection))
        if filter is not None:
            out = out.filter(filter)
        return out if max_rows is None else out.limit(max_rows)
    raw = spark.read.schema(_raw_schema(s, defaults)).options(**_options(delimiter, quote, header, multi_line)).csv(path)
    if skip_rows:
        # files by their paths, then the blocks of a file, within which ids grow
        place = raw.metadataColumn("_metadata")
        row = fresh_name(raw, "row")
        placed = raw.withColumn(row, F.struct(place["file_path"], place["file_block_start"], F.monotonically_increasing_id()))
        first = placed.select(row).orderBy(row).limit(skip_rows)
        last = first.agg(F.max(row)).first()[0]
        if last is not None:
            raw = placed.filter(F.col(row) > F.struct(F.lit(last[0]), *(F.lit(v).cast("long") for v in last[1:]))).drop(row)
    kept = s if projection is None else T.StructType([s[i] for i in projection])
    out = _typed(raw, kept, defaults)
    if filter is not None:
        out = out.filter(filter)
    return out if max_rows is None else out.limit(max_rows)


def from_csv_string(spark: SparkSession, text: str, schema, delimiter: str = ",", quote: str = '"', header: bool = True, skip_rows: int = 0, max_rows: int | None = None, defaults: bool = False) -> DataFrame:
    """CSV text on the driver."""
    import csv
    import io

    s = schema if isinstance(schema, T.StructType) else make_schema(schema)
    if len(delimiter) != 1 or len(quote) != 1:
        raise SourceError("delimiter and quote are single characters")
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter, quotechar=quote) if r]
    rows = rows[int(header) + skip_rows :][: max_rows if max_rows is not None else None]
    width = len(s)
    filled = [tuple((r + [None] * width)[:width]) for r in rows]
    raw = spark.createDataFrame(filled, T.StructType([T.StructField(f.name, T.StringType()) for f in s]))
    return _typed(raw, s, defaults)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(sep=delimiter, header=str(header).lower(), escape='"').csv(path)
