"""Registered checks: each name maps to a Spark callable and an oracle SQL text.

The Spark side always calls the library operator on the driver tables (or on
frames Spark derives from them); the SQL side restates the same contract in
plain ANSI SQL for DuckDB.  Derived "messy" inputs are defined once here, in
both dialects, so the two engines see identical data.

Outputs round doubles to 6 decimals on both sides and alias every column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        _SPARK[name] = fn
        if sql is not None:
            _SQL[name] = expand_r6(sql.strip())
        return fn

    return deco


NUDGE = 1e-12  # relative nudge so values sitting on a rounding half agree across engines


def expand_r6(sql: str) -> str:
    """Rewrite ``R6(expr)`` into the rounding used by :func:`r6` on the Spark side."""
    out, i = [], 0
    while True:
        j = sql.find("R6(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        k, depth = j + 3, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = expand_r6(sql[j + 3 : k - 1])
        out.append(f"round(CAST(({inner}) AS DOUBLE) * (1 + {NUDGE}), 6)")
        i = k


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(_SPARK)


def sql_queries() -> dict[str, str]:
    _load_all()
    return dict(_SQL)


def _load_all() -> None:
    # importing the modules registers their checks
    from quarry.checks import (  # noqa: F401
        check_profile,
        check_prep,
        check_eval,
        check_features,
        check_plans,
        check_text,
        check_cluster,
        check_stages,
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from quarry.sources.readers import load_table

    return load_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c):
    """Round a double column to 6 decimals after the same nudge as ``R6`` in SQL."""
    return F.round(c.cast("double") * F.lit(1 + NUDGE), 6)
