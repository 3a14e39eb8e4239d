"""Null model.

The modelled tool treats NaN and None alike as *missing*, while +-inf is a
value until explicitly replaced.  Spark keeps NULL, NaN and inf apart, so every
numeric entry point goes through :func:`nan_to_null`; :func:`finite_or_null`
is the separate inf-to-missing step used only where the spec asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c, dtype: T.DataType | None = None) -> Column:
    """NaN -> NULL for floating columns; other types pass through unchanged."""
    col = _col(c)
    if dtype is not None and not isinstance(dtype, FLOATING):
        return col
    return F.when(~F.isnan(col), col)


def finite_or_null(c) -> Column:
    """NaN and +-inf -> NULL (expects a numeric column; result is double)."""
    col = _col(c).cast("double")
    return F.when(F.abs(col) < F.lit(float("inf")), col)


def is_missing(c, dtype: T.DataType | None = None) -> Column:
    """True where the value is NULL, or NaN for floating columns."""
    col = _col(c)
    if dtype is not None and isinstance(dtype, FLOATING):
        return col.isNull() | F.isnan(col)
    return col.isNull()
