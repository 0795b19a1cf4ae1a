"""Sources and sinks."""

from .csv import from_csv_string, read_csv, write_csv
from .memory import empty, from_arrays, from_batches, from_columns, from_records, range_frame
from .parquet import cached_read, read_parquet, write_bucketed, write_parquet

__all__ = [n for n in dir() if not n.startswith("__")]
