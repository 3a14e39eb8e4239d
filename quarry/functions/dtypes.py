"""Logical column types.

Four logical types, tested in a fixed order (boolean before numeric):
boolean, datetime, numeric, categorical.  Nested types (array/map/struct) and
anything else fall into categorical; profiling only counts their missingness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def logical_dtype(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, DATETIME_TYPES):
        return "datetime"
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    return "categorical"


def column_types(df: DataFrame) -> dict[str, str]:
    """Ordered mapping column -> logical dtype (schema walk, no Spark job)."""
    return {f.name: logical_dtype(f.dataType) for f in df.schema.fields}


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [c for c, t in column_types(df).items() if t == "numeric" and c not in exclude]


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    return [c for c, t in column_types(df).items() if t == "categorical" and c not in exclude]


def is_nested(dt: T.DataType) -> bool:
    return isinstance(dt, NESTED_TYPES)
