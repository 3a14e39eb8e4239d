"""Array-vector expressions (no vector functions exist in ``pyspark.sql.functions``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, v: s + v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL when either vector has zero norm."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


def sq_dist(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v)


def log_scale(a: Column) -> Column:
    """Opt-in: sign(x) * log1p(|x|) per element, so raw row counts do not dominate."""
    return F.transform(a, lambda x: F.signum(x) * F.log1p(F.abs(x)))
