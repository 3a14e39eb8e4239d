"""Column-expression helpers shared by the operators."""

from quarry.functions.nulls import finite_or_null, is_missing, nan_to_null
from quarry.functions.dtypes import column_types, logical_dtype, numeric_columns, categorical_columns

__all__ = [
    "finite_or_null",
    "is_missing",
    "nan_to_null",
    "column_types",
    "logical_dtype",
    "numeric_columns",
    "categorical_columns",
]
