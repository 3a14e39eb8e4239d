"""Feature preparation stages (F-1 .. F-16) as ``pyspark.ml`` Estimators/Models.

Each stage fits with **one** aggregation over all of its columns (the training
frame is scanned once per stage; callers cache the training fold), and its
model is a pure column projection, so a fitted plan is an ordinary
``PipelineModel`` whose transform stays inside whole-stage codegen.

Numeric chain: inf->null, drop-empty, impute, [winsorize], drop-constant,
[scale].  Categorical chain: most-frequent impute, encode.  Columns are
transformed in place (same names); drop stages remove columns, and the
assembler picks up whatever survived.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import checkpoint

from quarry.functions.ranking import dense_codes
from quarry.functions.stats import column_quantiles
from quarry.operators.chained import RIDGE, cross_products, solve
from quarry.operators.folds import CROSS_COLUMN, CROSS_FOLDS
from quarry.operators.persist import Saved

# Fixed values.
WINSOR_FACTOR = 1.5
TARGET_SMOOTHING = 10.0  # documented smoothing m of (sum_y + m * prior) / (n + m)
ITERATIVE_MAX_SWEEPS = 10
ITERATIVE_TOL = 1e-3
PATTERN_CELLS = 2_000_000  # numbers in the cross-product matrices of all missingness patterns on the driver


def _q(c):
    return F.col(f"`{c}`")


class _Stage:
    """Shared helpers; subclasses keep their fitted state in plain attributes."""

    def _present(self, df: DataFrame, cols):
        have = set(df.columns)
        return [c for c in cols if c in have]


class InfToNull(Transformer, Saved, _Stage):
    """F-1: +-inf and NaN -> NULL, result double."""

    SAVED = ("cols",)

    def __init__(self, cols):
        super().__init__()
        self.cols = list(cols)

    def _transform(self, df):
        cols = set(self._present(df, self.cols))
        return df.select(
            *[F.when(F.abs(_q(c).cast("double")) < F.lit(float("inf")), _q(c).cast("double")).alias(c) if c in cols else _q(c)
              for c in df.columns]
        )


class _DropModel(Model, Saved):
    SAVED = ("drop",)

    def __init__(self, drop):
        super().__init__()
        self.drop = list(drop)

    def _transform(self, df):
        return df.drop(*[c for c in self.drop if c in df.columns])


class DropEmpty(Estimator, _Stage):
    """F-2: drop columns with no observed value in the training data."""

    def __init__(self, cols):
        super().__init__()
        self.cols = list(cols)

    def _fit(self, df):
        cols = self._present(df, self.cols)
        if not cols:
            return _DropModel([])
        row = df.agg(*[F.count(_q(c)).alias(c) for c in cols]).first()
        return _DropModel([c for c in cols if row[c] == 0])


class DropConstant(Estimator, _Stage):
    """F-8: drop columns with zero variance on the training data.

    Told by equal extremes: the variance itself is not exactly zero once
    partial means are merged.
    """

    def __init__(self, cols):
        super().__init__()
        self.cols = list(cols)

    def _fit(self, df):
        cols = self._present(df, self.cols)
        if not cols:
            return _DropModel([])
        row = df.agg(*[(F.min(_q(c)) < F.max(_q(c))).alias(c) for c in cols]).first()
        return _DropModel([c for c in cols if not row[c]])


class _FillModel(Model, Saved):
    SAVED = ("values",)

    def __init__(self, values):
        super().__init__()
        self.values = dict(values)

    def _transform(self, df):
        return df.select(
            *[F.coalesce(_q(c), F.lit(self.values[c])).alias(c) if c in self.values and self.values[c] is not None else _q(c)
              for c in df.columns]
        )


class SimpleImpute(Estimator, _Stage):
    """F-3: mean or median (exact, interpolated) imputation."""

    def __init__(self, cols, strategy="median"):
        super().__init__()
        if strategy not in ("mean", "median"):
            raise ValueError(f"Unknown imputation strategy: '{strategy}'")
        self.cols, self.strategy = list(cols), strategy

    def _fit(self, df):
        cols = self._present(df, self.cols)
        if not cols:
            return _FillModel({})
        if self.strategy == "mean":
            row = df.agg(*[F.avg(_q(c)).alias(c) for c in cols]).first()
            return _FillModel({c: row[c] for c in cols})
        med = column_quantiles(df, cols, [0.5])
        return _FillModel({c: (med[c][0] if med[c] else None) for c in cols})


class MostFrequentImpute(Estimator, _Stage):
    """F-6: per column, the most frequent non-null value (ties -> smallest value).

    One unpivot + ``groupBy(column, value)`` job; the arg-max is a bounded
    top-1 per column (partial window-group limit before the exchange).
    """

    def __init__(self, cols):
        super().__init__()
        self.cols = list(cols)

    def _fit(self, df):
        cols = self._present(df, self.cols)
        if not cols:
            return _FillModel({})
        kv = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), _q(c).cast("string").alias("v")) for c in cols]))
        counts = df.select(kv.alias("kv")).select("kv.c", "kv.v").where(F.col("v").isNotNull()).groupBy("c", "v").count()
        w = Window.partitionBy("c").orderBy(F.desc("count"), F.asc("v"))
        top = counts.withColumn("r", F.row_number().over(w)).where("r = 1").collect()
        return _FillModel({r["c"]: r["v"] for r in top})


class _ClipModel(Model, Saved):
    SAVED = ("bounds",)

    def __init__(self, bounds):
        super().__init__()
        self.bounds = dict(bounds)

    def _transform(self, df):
        out = []
        for c in df.columns:
            if c in self.bounds:
                lo, hi = self.bounds[c]
                # least/greatest skip NULLs, so guard to keep missing values missing
                out.append(F.when(_q(c).isNotNull(), F.least(F.greatest(_q(c), F.lit(lo)), F.lit(hi))).alias(c))
            else:
                out.append(_q(c))
        return df.select(*out)


class Winsorizer(Estimator, _Stage):
    """F-7: clip to the training fence [q1 - f*iqr, q3 + f*iqr]; bounds never refit on test."""

    def __init__(self, cols, factor=WINSOR_FACTOR):
        super().__init__()
        self.cols, self.factor = list(cols), factor

    def _fit(self, df):
        cols = self._present(df, self.cols)
        if not cols:
            return _ClipModel({})
        qs = column_quantiles(df, cols, [0.25, 0.75])
        bounds = {}
        for c in cols:
            if qs[c] is None:
                continue
            q1, q3 = qs[c]
            iqr = q3 - q1
            bounds[c] = (q1 - self.factor * iqr, q3 + self.factor * iqr)
        return _ClipModel(bounds)


class _AffineModel(Model, Saved):
    SAVED = ("affine",)

    def __init__(self, affine):
        super().__init__()
        self.affine = dict(affine)  # column -> (shift, scale)

    def _transform(self, df):
        return df.select(
            *[((_q(c) - F.lit(self.affine[c][0])) / F.lit(self.affine[c][1])).alias(c) if c in self.affine else _q(c)
              for c in df.columns]
        )


class Scaler(Estimator, _Stage):
    """F-9 standard (mean, population std), F-10 robust (median, IQR), F-11 min-max.

    A zero spread maps to a divisor of 1 (constants become 0).
    """

    def __init__(self, cols, kind="standard"):
        super().__init__()
        if kind not in ("standard", "robust", "minmax"):
            raise ValueError(f"Unknown scaling strategy: '{kind}'")
        self.cols, self.kind = list(cols), kind

    def _fit(self, df):
        cols = self._present(df, self.cols)
        if not cols:
            return _AffineModel({})
        exprs = []
        for c in cols:
            if self.kind == "standard":
                exprs += [F.avg(_q(c)).alias(f"a::{c}"), F.stddev_pop(_q(c)).alias(f"b::{c}")]
            elif self.kind == "minmax":
                exprs += [F.min(_q(c)).alias(f"a::{c}"), F.max(_q(c)).alias(f"b::{c}")]
        if self.kind == "robust":
            qs = column_quantiles(df, cols, [0.25, 0.5, 0.75])
            row = {f"q::{c}": qs[c] for c in cols}
        else:
            row = df.agg(*exprs).first()
        params = {}
        for c in cols:
            if self.kind == "standard":
                shift, spread = row[f"a::{c}"], row[f"b::{c}"]
            elif self.kind == "robust":
                q = row[f"q::{c}"]
                shift, spread = (q[1], q[2] - q[0]) if q else (None, None)
            else:
                shift, hi = row[f"a::{c}"], row[f"b::{c}"]
                spread = None if shift is None else hi - shift
            if shift is None:
                continue
            params[c] = (shift, spread if spread else 1.0)
        return _AffineModel(params)


def _coded(df: DataFrame, tables: dict, cols: list[str], unseen: dict) -> DataFrame:
    """Adds ``<c>__idx`` (double) from the dictionary of each column; values it does not hold get ``unseen[c]``."""
    out = df
    for c in cols:
        t = tables[c].select(F.col("__v").alias("__w"), F.col("__code").cast("double").alias("__k"))
        out = out.join(t, F.col(f"`{c}`").cast("string") == F.col("__w"), "left").withColumn(
            f"{c}__idx", F.coalesce(F.col("__k"), F.lit(float(unseen[c])))).drop("__w", "__k")
    return out


def category_dictionary(df: DataFrame, cols: list[str]) -> tuple[dict, dict]:
    """({column: DataFrame (__v, __code)}, {column: number of categories}): categories in value order, codes from 0.

    The dictionary stays a table, written once (checkpoint); only its length
    comes to the driver, so the number of categories has no bound there.
    """
    tables = {c: checkpoint(dense_codes(df.select(_q(c).cast("string").alias("__v")), "__v", "__code")) for c in cols}
    return tables, {c: t.count() for c, t in tables.items()}


class _OrdinalModel(Model, Saved):
    SAVED = ("tables", "cols")

    def __init__(self, tables, cols):
        super().__init__()
        self.tables, self.cols = dict(tables), list(cols)

    def _transform(self, df):
        out = _coded(df, self.tables, self.cols, dict.fromkeys(self.cols, -1.0))
        return out.select(*[_q(c) for c in df.columns if c not in self.cols], *[F.col(f"`{c}__idx`").alias(f"{c}__enc") for c in self.cols])


class OrdinalEncode(Estimator, _Stage):
    """F-14: categories sorted, code = position, unseen -> -1."""

    def __init__(self, cols):
        super().__init__()
        self.cols = list(cols)

    def _fit(self, df):
        cols = self._present(df, self.cols)
        return _OrdinalModel(category_dictionary(df, cols)[0], cols)


class _OneHotModel(Model, Saved):
    SAVED = ("tables", "sizes", "cols")

    def __init__(self, tables, sizes, cols):
        super().__init__()
        self.tables, self.sizes, self.cols = dict(tables), dict(sizes), list(cols)

    def _transform(self, df):
        out = _coded(df, self.tables, self.cols, self.sizes)
        # the number of codes alone, no labels: unseen values have the last code, which is dropped
        nominal = {c: {"ml_attr": {"type": "nominal", "num_vals": self.sizes[c] + 1}} for c in self.cols}
        out = out.select(*[_q(c) for c in df.columns], *[F.col(f"`{c}__idx`").alias(f"{c}__idx", metadata=nominal[c]) for c in self.cols])
        enc = OneHotEncoder(inputCols=[f"{c}__idx" for c in self.cols], outputCols=[f"{c}__enc" for c in self.cols],
                            dropLast=True, handleInvalid="error")
        return enc.fit(out).transform(out).drop(*[f"{c}__idx" for c in self.cols])


class OneHotEncode(Estimator, _Stage):
    """F-12: one column per seen category; unseen -> all zeros; no level dropped.

    Codes come from a joined dictionary (:func:`category_dictionary`), with one
    more code for unseen values; OneHotEncoder with dropLast drops that slot.
    """

    def __init__(self, cols):
        super().__init__()
        self.cols = list(cols)

    def _fit(self, df):
        cols = self._present(df, self.cols)
        return _OneHotModel(*category_dictionary(df, cols), cols)


def left_out_mean(total: Column, part: Column, n: Column, n_part: Column, prior: Column, m: float) -> Column:
    """Smoothed mean of a category without one inner fold."""
    return (total - part + m * prior) / (n - n_part + m)


class _TargetEncModel(Model, Saved):
    """Rows with an inner fold (``CROSS_COLUMN``, the training rows) get the table without that fold; all others the full one."""

    SAVED = ("tables", "prior", "cols", "classes", "left_out")

    def __init__(self, tables, prior, cols, classes, left_out=None):
        super().__init__()
        self.tables, self.prior, self.cols, self.classes = tables, prior, list(cols), classes
        self.left_out = left_out  # per target: the prior without each inner fold

    def _transform(self, df):
        crossed = CROSS_COLUMN in df.columns and self.left_out
        fold = F.col(CROSS_COLUMN) if crossed else None
        out = df
        for c in self.cols:
            t = self.tables[c]
            out = out.join(t, out[f"`{c}`"].eqNullSafe(t["__v"]), "left").drop("__v")
            for k, p in enumerate(self.prior):
                full = F.coalesce(F.col(f"__te{k}"), F.lit(p))
                if crossed:
                    lone = F.array(*[F.lit(x) for x in self.left_out[k]])
                    full = F.when(fold.isNotNull(), F.coalesce(F.col(f"__lo{k}")[fold], lone[fold])).otherwise(full)
                out = out.withColumn(f"{c}__te{k}", full)
            out = out.drop(*[x for x in t.columns if x != "__v"])
        return out


class TargetEncode(Estimator, _Stage):
    """F-13: smoothed target mean per category, (sum_y + m * prior) / (n + m).

    Binary/regression: one column; multiclass: one column per class.  Training
    rows are cross-fitted when the frame carries ``CROSS_COLUMN``
    (``folds.cross_folds``): a row of inner fold j is encoded with sums, counts
    and prior of the other inner folds, so its own label never enters.  These
    tables are the totals minus the fold, from the same one aggregation.  A
    category that only fold j holds gets the prior without j.

    The per-category table has one row per distinct category; it is checkpointed
    and stays a DataFrame, whose measured size decides how it is joined.
    """

    def __init__(self, cols, label="label", classes=None, smoothing=TARGET_SMOOTHING, parts=CROSS_FOLDS):
        super().__init__()
        self.cols, self.label, self.classes, self.m, self.parts = list(cols), label, classes, smoothing, parts

    def _fit(self, df):
        cols = self._present(df, self.cols)
        y = F.col(self.label).cast("double")
        targets = [y] if not self.classes or len(self.classes) <= 2 else [
            (F.col(self.label) == float(i)).cast("double") for i in range(len(self.classes))
        ]
        inner = [F.col(CROSS_COLUMN) == j for j in range(self.parts)] if CROSS_COLUMN in df.columns else []

        def sums():
            out = [F.count(F.lit(1)).alias("__n"), *[F.sum(t).alias(f"__s{k}") for k, t in enumerate(targets)]]
            if inner:
                out.append(F.array(*[F.count(F.when(j, 1)) for j in inner]).alias("__np"))
                out += [F.array(*[F.coalesce(F.sum(F.when(j, t)), F.lit(0.0)) for j in inner]).alias(f"__sp{k}") for k, t in enumerate(targets)]
            return out

        whole = df.agg(*sums()).first()
        n = whole["__n"]
        prior = [whole[f"__s{k}"] / n if n else None for k in range(len(targets))]
        left_out = None
        if inner and n:
            left_out = [[(whole[f"__s{k}"] - whole[f"__sp{k}"][j]) / (n - whole["__np"][j]) if n > whole["__np"][j] else prior[k]
                         for j in range(self.parts)] for k in range(len(targets))]
        tables = {}
        for c in cols:
            agg = df.groupBy(F.col(f"`{c}`").alias("__v")).agg(*sums())
            out = [((F.col(f"__s{k}") + self.m * prior[k]) / (F.col("__n") + self.m)).alias(f"__te{k}") for k in range(len(targets))]
            if left_out:
                out += [F.array(*[left_out_mean(F.col(f"__s{k}"), F.col(f"__sp{k}")[j], F.col("__n"), F.col("__np")[j], F.lit(left_out[k][j]), self.m)
                                  for j in range(self.parts)]).alias(f"__lo{k}") for k in range(len(targets))]
            tables[c] = checkpoint(agg.select("__v", *out))
        return _TargetEncModel(tables, prior, cols, self.classes, left_out)


class _AssembleModel(Model, Saved):
    SAVED = ("inputs", "output")

    def __init__(self, inputs, output):
        super().__init__()
        self.inputs, self.output = inputs, output
        self.assembler = VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="keep")

    def _transform(self, df):
        return self.assembler.transform(df)


class AssembleFeatures(Estimator, _Stage):
    """Vector of the numeric columns that survived plus the encoded categoricals."""

    def __init__(self, numeric, categorical, output="features"):
        super().__init__()
        self.numeric, self.categorical, self.output = list(numeric), list(categorical), output

    def _fit(self, df):
        have = set(df.columns)
        inputs = [c for c in self.numeric if c in have]
        for c in self.categorical:
            inputs += [x for x in df.columns if x.startswith(f"{c}__te")] if f"{c}__enc" not in have else [f"{c}__enc"]
        if not inputs:
            raise ValueError("No numeric or categorical columns found — cannot build a pipeline.")
        return _AssembleModel(inputs, self.output)


class IterativeImpute(Estimator, _Stage):
    """F-5: chained-equation imputation.

    Mean start, then per sweep and per column (ascending missingness) a
    linear regression on the other columns, fitted on rows where the column is
    observed, replaces the missing entries.  Stops after 10 sweeps or when the
    largest change of an imputed mean falls below the tolerance.

    All sweeps run on one table of cross products by missingness pattern
    (:mod:`quarry.operators.chained`): three jobs in all.  Where the patterns'
    matrices together pass ``PATTERN_CELLS`` numbers, the same regressions are
    fitted on the rows instead, one job per column and sweep.
    """

    def __init__(self, cols, max_sweeps=ITERATIVE_MAX_SWEEPS, tol=ITERATIVE_TOL, pattern_cells=PATTERN_CELLS):
        super().__init__()
        self.cols, self.max_sweeps, self.tol, self.pattern_cells = list(cols), max_sweeps, tol, pattern_cells

    def _fit(self, df):
        cols = self._present(df, self.cols)
        stats = df.agg(*[F.avg(_q(c)).alias(f"m::{c}") for c in cols], *[F.stddev_pop(_q(c)).alias(f"s::{c}") for c in cols],
                       *[F.count(_q(c)).alias(f"n::{c}") for c in cols], F.count(F.lit(1)).alias("n")).first()
        cols = [c for c in cols if stats[f"n::{c}"]]  # nothing to learn from a column without values
        means = {c: stats[f"m::{c}"] for c in cols}
        missing = sorted([c for c in cols if stats[f"n::{c}"] < stats["n"]], key=lambda c: -stats[f"n::{c}"])
        if len(cols) < 2 or not missing:
            return _IterativeModel(means, {}, missing)
        gaps = df.agg(F.countDistinct(F.concat(*[F.when(_q(c).isNull(), "1").otherwise("0") for c in missing]))).first()[0]
        if gaps * (len(cols) + 1) ** 2 > self.pattern_cells:
            coefs = self._by_rows(df, cols, means, missing)
        else:
            coefs = self._by_patterns(df, cols, means, {c: stats[f"s::{c}"] or 1.0 for c in cols}, missing)
        return _IterativeModel(means, coefs, missing)

    def _by_patterns(self, df, cols, means, scales, missing):
        d, m, s = len(cols), [means[c] for c in cols], [scales[c] for c in cols]
        cells = cross_products(df, cols, m, s).toPandas()  # gaps * (d + 1)^2 / 2 rows, bounded by pattern_cells
        patterns = sorted(cells["pattern"].unique())
        products = np.zeros((len(patterns), (d + 1) ** 2))
        products[cells["pattern"].map({p: i for i, p in enumerate(patterns)}), cells["cell"]] = cells["v"]
        products = products.reshape(-1, d + 1, d + 1)
        products = np.triu(products) + np.transpose(np.triu(products, 1), (0, 2, 1))
        got = solve(patterns, products, [cols.index(c) for c in missing], m, s, self.max_sweeps, self.tol)
        return {cols[c]: (w, b, [o for o in cols if o != cols[c]]) for c, (w, b) in got.items()}

    def _by_rows(self, df, cols, means, missing):
        coefs = {}
        flags = [F.col(f"`{c}`").isNull().alias(f"{c}__miss") for c in missing]
        cur = df.select(*[F.coalesce(_q(c), F.lit(means[c])).alias(c) for c in cols], *flags)
        prev = None
        for _ in range(self.max_sweeps):
            for c in missing:
                others = [o for o in cols if o != c]
                va = VectorAssembler(inputCols=others, outputCol="__x")
                train = va.transform(cur.where(~F.col(f"{c}__miss")))
                lr = LinearRegression(featuresCol="__x", labelCol=c, regParam=RIDGE, solver="normal").fit(train)
                coefs[c] = ([float(w) for w in lr.coefficients], lr.intercept, others)
                pred = F.lit(lr.intercept)
                for w, o in zip(lr.coefficients, others):
                    pred = pred + F.lit(float(w)) * F.col(f"`{o}`")
                cur = cur.withColumn(c, F.when(F.col(f"{c}__miss"), pred).otherwise(F.col(f"`{c}`")))
            cur = checkpoint(cur)
            now = cur.agg(*[F.avg(F.when(F.col(f"{c}__miss"), F.col(f"`{c}`"))).alias(c) for c in missing]).first()
            if prev is not None and max(abs((now[c] or 0) - (prev[c] or 0)) for c in missing) < self.tol:
                break
            prev = now
        return coefs


class _IterativeModel(Model, Saved):
    SAVED = ("means", "coefs", "order")

    def __init__(self, means, coefs, order):
        super().__init__()
        self.means, self.coefs, self.order = means, coefs, order

    def _transform(self, df):
        miss = {c: _q(c).isNull() for c in self.means}
        out = df.select(*[F.coalesce(_q(c), F.lit(self.means[c])).alias(c) if c in self.means else _q(c) for c in df.columns],
                        *[m.alias(f"{c}__miss") for c, m in miss.items()])
        for c in self.order:
            if c not in self.coefs:
                continue
            w, b, others = self.coefs[c]
            pred = F.lit(b)
            for wi, o in zip(w, others):
                pred = pred + F.lit(float(wi)) * F.col(f"`{o}`")
            out = out.withColumn(c, F.when(F.col(f"{c}__miss"), pred).otherwise(F.col(f"`{c}`")))
        return out.drop(*[f"{c}__miss" for c in self.means])


def class_weight_column(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """F-16: balanced weights n / (k * n_class), joined from the per-class count table."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    tot = counts.agg(F.sum("__nc").alias("__n"), F.count(F.lit(1)).alias("__k")).first()
    w = counts.select(label, (F.lit(float(tot["__n"])) / (F.lit(float(tot["__k"])) * F.col("__nc"))).alias(out))
    # one row per class: a bounded broadcast
    return df.join(F.broadcast(w), label)


def factorize(df: DataFrame, cols: list[str]) -> DataFrame:
    """F-15: strings -> dense integer codes (as double) in value order; NULL -> -1.

    Codes come from a distributed sort of each column's distinct values
    (range-partitioned, no single-task window over the values); the code table
    is joined back by shuffle, sized by the distinct values.
    """
    out = df
    for c in cols:
        vals = df.select(_q(c).cast("string").alias("__v"))
        codes = dense_codes(vals, "__v", "__code").withColumn("__code", F.col("__code").cast("double"))
        out = out.join(codes, out[f"`{c}`"].cast("string") == codes["__v"], "left").withColumn(
            c, F.coalesce(F.col("__code"), F.lit(-1.0))
        ).drop("__v", "__code")
    return out
