"""Names of the sixteen column kinds and helpers on StructType."""

from __future__ import annotations

from pyspark.sql import types as T

from .errors import ColumnError, SchemaError

#: Kinds and the Spark types that hold all their values; unsigned kinds widen by a step.
KINDS: dict[str, T.DataType] = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "boolean": T.BooleanType(),
    "string": T.StringType(), "string_dict": T.StringType(), "string_view": T.StringType(),
    "date": T.DateType(), "timestamp": T.TimestampType(),
}
#: Largest values of the unsigned kinds.
UNSIGNED = {"uint8": 2**8 - 1, "uint16": 2**16 - 1, "uint32": 2**32 - 1, "uint64": 2**64 - 1}
NAME_LIMIT = 256


def spark_type(kind: str | T.DataType) -> T.DataType:
    if isinstance(kind, T.DataType):
        return kind
    try:
        return KINDS[kind]
    except KeyError:
        raise SchemaError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}") from None


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType) or (isinstance(t, T.DecimalType) and t.scale == 0)


def is_big_integer(t: T.DataType) -> bool:
    return isinstance(t, T.LongType) or (isinstance(t, T.DecimalType) and t.scale == 0)


def validate_spec(spec: dict) -> None:
    """Raises SchemaError for an empty specification or a bad name or kind."""
    if not spec:
        raise SchemaError("a schema needs a column")
    for name, kind in spec.items():
        if not isinstance(name, str) or not 1 <= len(name) <= NAME_LIMIT:
            raise SchemaError(f"column names have 1 to {NAME_LIMIT} characters: {name!r}")
        spark_type(kind)


def make_schema(spec: dict | list[tuple[str, str | T.DataType]]) -> T.StructType:
    """Ordered, name-unique schema of kinds; all columns are nullable, and the kind stays in the field's metadata."""
    pairs = list(spec.items()) if isinstance(spec, dict) else list(spec)
    names = [n for n, _ in pairs]
    if len(set(names)) < len(names):
        raise SchemaError(f"duplicate column names: {sorted({n for n in names if names.count(n) > 1})}")
    validate_spec(dict(pairs))
    return T.StructType([T.StructField(n, spark_type(k), True, {"kind": k} if isinstance(k, str) else {}) for n, k in pairs])


def compare_schemas(a: T.StructType, b: T.StructType) -> list[str]:
    """What differs, in order of the columns; empty if names, order and types agree."""
    out = [] if len(a) == len(b) else [f"{len(a)} columns against {len(b)}"]
    for i, (x, y) in enumerate(zip(a, b)):
        if x.name != y.name:
            out.append(f"column {i}: {x.name} against {y.name}")
        elif x.dataType != y.dataType:
            out.append(f"{x.name}: {x.dataType.simpleString()} against {y.dataType.simpleString()}")
    return out


def is_schema_equal(a: T.StructType, b: T.StructType) -> bool:
    return not compare_schemas(a, b)


def fresh_name(df, name: str) -> str:
    """name, or name with underscores in front until df has no such column, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def get_column(schema: T.StructType, name: str) -> T.StructField:
    if name not in schema.fieldNames():
        raise ColumnError(f"no column {name!r}; there are {schema.fieldNames()}")
    return schema[name]


def get_column_by_index(schema: T.StructType, index: int) -> T.StructField:
    if not 0 <= index < len(schema):
        raise ColumnError(f"no column {index} of {len(schema)}")
    return schema[index]


def get_column_index(schema: T.StructType, name: str) -> int:
    get_column(schema, name)
    return schema.fieldNames().index(name)


def has_column(schema: T.StructType, name: str) -> bool:
    return name in schema.fieldNames()


def get_column_names(schema: T.StructType) -> list[str]:
    return schema.fieldNames()


def select_columns(schema: T.StructType, names: list[str]) -> T.StructType:
    return T.StructType([get_column(schema, n) for n in names])


def rename_column(schema: T.StructType, old: str, new: str) -> T.StructType:
    get_column(schema, old)
    if new != old and has_column(schema, new):
        raise SchemaError(f"column {new!r} exists")
    return T.StructType([T.StructField(new if f.name == old else f.name, f.dataType, f.nullable, f.metadata) for f in schema])


def add_column(schema: T.StructType, name: str, kind: str | T.DataType) -> T.StructType:
    if has_column(schema, name):
        raise SchemaError(f"column {name!r} exists")
    return T.StructType([*schema.fields, T.StructField(name, spark_type(kind), True)])


def drop_columns(schema: T.StructType, names: list[str]) -> T.StructType:
    left = [f for f in schema if f.name not in names]
    if not left:
        raise SchemaError("no column would be left")
    return T.StructType(left)


def format_schema(schema: T.StructType) -> str:
    return "\n".join(f"{f.name}: {f.metadata.get('kind', f.dataType.simpleString())}{'?' if f.nullable else ''}" for f in schema)
