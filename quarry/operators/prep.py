"""Table preparation before modelling (P-1 .. P-10, D-1, A-11).

``prepare`` runs three aggregation jobs regardless of width (plus one checkpoint write):

1. one aggregation measuring how many values of each string column parse as
   numbers (P-5);
2. one aggregation over the de-duplicated frame giving row count, per-column
   non-null counts and min/max (P-6 missingness and P-7 constancy);
3. the rare-class count on the target (A-11).

The de-duplicated frame (one shuffle, map-side combined) is checkpointed to
the session's checkpoint folder, because both aggregations and every later
step of a run read it; the result is that table minus the dropped columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import checkpoint
from pyspark.sql import types as T

from quarry.functions.dtypes import is_nested
from quarry.functions.nulls import FLOATING, nan_to_null
from quarry.operators.profile import class_distribution

# Fixed values of the preparation step.
COERCE_MIN_SHARE = 0.8  # share of non-null strings that must parse
MAX_MISSING_RATE = 0.99  # strictly greater is dropped
MIN_CLASS_SAMPLES = 5  # strictly fewer is reported

# pandas-compatible numeric literal: optional sign, digits with optional point,
# or a leading-point fraction, optional exponent, surrounding blanks allowed.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INF_PATTERN = r"^\s*[+-]?(inf|infinity)\s*$"


@dataclass
class PrepConfig:
    max_missing_rate: float = MAX_MISSING_RATE
    drop_duplicates: bool = True
    coerce_numeric: bool = True
    min_class_samples: int = MIN_CLASS_SAMPLES


@dataclass
class PrepReport:
    rows_before: int = 0
    rows_after: int = 0
    cols_before: int = 0
    cols_after: int = 0
    dropped_all_nan: list = field(default_factory=list)
    dropped_constant: list = field(default_factory=list)
    dropped_duplicate_rows: int = 0
    coerced_columns: list = field(default_factory=list)
    rare_classes: list = field(default_factory=list)

    @property
    def n_cols_dropped(self) -> int:
        return len(self.dropped_all_nan) + len(self.dropped_constant)

    def to_frame(self, spark) -> DataFrame:
        """P-9: one-row report."""
        return spark.createDataFrame(
            [(
                self.rows_before, self.rows_after, self.cols_before, self.cols_after,
                self.dropped_all_nan, self.dropped_constant, self.dropped_duplicate_rows,
                self.coerced_columns, self.rare_classes, self.n_cols_dropped,
            )],
            "rows_before bigint, rows_after bigint, cols_before int, cols_after int, "
            "dropped_all_nan array<string>, dropped_constant array<string>, dropped_duplicate_rows bigint, "
            "coerced_columns array<string>, rare_classes array<string>, n_cols_dropped int",
        )


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def parse_number(c: Column) -> Column:
    """String -> double with pandas ``to_numeric`` acceptance; anything else -> NULL.

    Spark's own cast is more lenient ('5d', '1_000'), so the guard decides.
    """
    s = F.trim(c)
    inf = F.when(F.trim(c).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return (
        F.when(c.rlike(NUMBER_PATTERN), s.try_cast("double"))
        .when(F.lower(c).rlike(INF_PATTERN), inf)
    )


def numeric_share_exprs(df: DataFrame, exclude=()) -> list:
    """Per string column: non-null count and parseable count (P-5 evidence)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType) and f.name not in exclude:
            out += [
                F.count(_q(f.name)).alias(f"nn::{f.name}"),
                F.count(parse_number(_q(f.name))).alias(f"ok::{f.name}"),
            ]
    return out


def coerce_numeric(df: DataFrame, target: str | None = None, min_share: float = COERCE_MIN_SHARE):
    """P-5: returns (frame, coerced column list, row count)."""
    exprs = numeric_share_exprs(df, exclude=(target,) if target else ())
    row = df.agg(F.count(F.lit(1)).alias("__n"), *exprs).first()
    coerced = []
    for f in df.schema.fields:
        if f"nn::{f.name}" in row.asDict():
            nn, ok = row[f"nn::{f.name}"], row[f"ok::{f.name}"]
            if nn > 0 and ok / nn >= min_share:
                coerced.append(f.name)
    if coerced:
        df = df.select(*[parse_number(_q(c)).alias(c) if c in coerced else _q(c) for c in df.columns])
    return df, coerced, int(row["__n"])


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """D-1: exact duplicates over all columns removed; NaN equals NaN (NaN -> NULL first)."""
    fixed = df.select(
        *[nan_to_null(_q(f.name)).alias(f.name) if isinstance(f.dataType, FLOATING) else _q(f.name) for f in df.schema.fields]
    )
    return fixed.dropDuplicates()


def column_presence(df: DataFrame, columns: list[str]) -> dict:
    """One aggregation: rows, per-column non-null count and whether min equals max."""
    exprs = [F.count(F.lit(1)).alias("__n")]
    for c in columns:
        dt = df.schema[c].dataType
        x = nan_to_null(_q(c), dt)
        exprs.append(F.count(x).alias(f"nn::{c}"))
        if not is_nested(dt):
            exprs.append(F.min(x).eqNullSafe(F.max(x)).alias(f"const::{c}"))
        else:
            exprs.append(F.lit(False).alias(f"const::{c}"))
    return df.agg(*exprs).first().asDict()


def prepare(df: DataFrame, target: str | None = None, cfg: PrepConfig | None = None):
    """P-8: coerce -> de-duplicate -> drop empty -> drop constant -> rare classes.

    Returns ``(clean DataFrame, PrepReport)``.  The target column is never
    coerced or dropped.  Preparation is applied before the train/test split,
    as in the modelled tool (it only removes empties, constants, duplicates).
    """
    cfg = cfg or PrepConfig()
    rep = PrepReport(cols_before=len(df.columns))
    out = df
    rows = None
    if cfg.coerce_numeric:
        out, rep.coerced_columns, rows = coerce_numeric(out, target)
    if cfg.drop_duplicates:
        # the de-duplicated table feeds two aggregations here and every later step of a run:
        # written once to the checkpoint folder (lineage cut, survives executor loss)
        out = checkpoint(drop_duplicate_rows(out))
    features = [c for c in out.columns if c != target]
    stats = column_presence(out, features)
    n_after = int(stats["__n"])
    if rows is None:
        rows = df.count() if cfg.drop_duplicates else n_after
    rep.rows_before = rows
    rep.dropped_duplicate_rows = rows - n_after if cfg.drop_duplicates else 0
    for c in features:
        miss = 1.0 - stats[f"nn::{c}"] / max(n_after, 1)
        if n_after and miss > cfg.max_missing_rate:
            rep.dropped_all_nan.append(c)
    for c in features:
        if c in rep.dropped_all_nan:
            continue
        if stats[f"nn::{c}"] == 0 or stats[f"const::{c}"]:
            rep.dropped_constant.append(c)
    drop = set(rep.dropped_all_nan) | set(rep.dropped_constant)
    out = out.select(*[_q(c) for c in out.columns if c not in drop])
    if target and target in out.columns:
        rare = class_distribution(out, target).where(F.col("n") < cfg.min_class_samples).orderBy("class")
        rep.rare_classes = [r["class"] for r in rare.collect()]
    rep.rows_after = n_after
    rep.cols_after = len(out.columns)
    return out, rep


def split_features(df: DataFrame, target: str | None) -> tuple[DataFrame, list[str]]:
    """P-1: feature columns (target dropped); ``None`` target keeps all columns."""
    feats = [c for c in df.columns if c != target]
    return df.select(*[_q(c) for c in feats]), feats


def complete_numeric_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """P-3: numeric columns only, +-inf/NaN -> NULL, rows with any NULL dropped."""
    proj = [F.when(F.abs(_q(c).cast("double")) < F.lit(float("inf")), _q(c).cast("double")).alias(c) for c in columns]
    return df.select(*proj).dropna("any")


def nonconstant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """P-4: columns whose *sample* std is > 0 (computed after the row drop)."""
    if not columns:
        return []
    row = df.agg(*[F.stddev_samp(_q(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] > 0]


def preview(df: DataFrame, key: list[str], n: int = 10) -> DataFrame:
    """P-10: first ``n`` rows by key order (a top-k report; the limit is the feature)."""
    return df.orderBy(*key).limit(n)
