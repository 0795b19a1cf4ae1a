"""Operators: functions that take a DataFrame first."""

from .groups import Grouped, aggregate, describe, group_by, median, scalar_max, scalar_mean, scalar_min, scalars, top_per_group
from .histogram import histogram
from .inspect import column_names, count, dtypes, explain, find_duplicates, for_each, group_by_prefix, is_empty, length_stats, map_batches, print_schema, reduce, show, stream_batches, stream_rows, to_columns, to_records
from .joins import anti_join, cross_join, full_join, inner_join, join, left_join, right_join, semi_join
from .order import SortKey, asc, desc, head, limit, number_rows, offset, order_by, slice_rows, sort, tail
from .rows import cast, count_nulls, drop, drop_null, explode_json, fill_backward, fill_forward, fill_null, fill_nulls, filter_rows, has_any_null, rename, replace_column, sample, select, select_as, shuffle, trim_column, where, with_column, with_columns
from .sets import concat, distinct, drop_duplicates, union, union_all, unique, validate_same_columns
from .text import compare, filter_by_byte_length, filter_by_char_length, filter_by_prefix, filter_by_suffix, lower_column, offset_of_code_point, pad_column, substring_column, upper_column

__all__ = [n for n in dir() if not n.startswith("__")]
