"""Model stages (M-1 .. M-7) and the plan -> ``Pipeline`` builder (F-18).

Parity notes (Spark objective vs the modelled scikit-learn defaults):

* logistic regression, L2 with C = 1: Spark minimises mean loss + lambda/2 |w|^2,
  so lambda = 1 / (C * n) with n the (weighted) training size, no
  standardisation, up to 1000 iterations;
* ridge with alpha = 1: lambda = alpha * sigma_y / n with the population std of
  the label (Spark rescales the label internally), normal-equation solver;
* random forest: 100 trees, seed 42, depth capped at 12 (Spark needs a cap);
* gradient boosting presets: "gradient_boosting" depth 3 / step .1 / 100 rounds,
  "xgboost" depth 6 / step .3, "lightgbm" depth 5 / step .1 / 255 bins; these
  run on Spark's GBT (the engine is recorded, the label is kept);
* multiclass boosting uses one-vs-rest; its probabilities are the normalised
  sigmoids of the per-class margins.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from quarry.operators import features as FE
from quarry.operators.persist import Saved

CLASSIFIERS = ["logistic_regression", "random_forest", "gradient_boosting", "xgboost", "lightgbm"]
REGRESSORS = ["linear_regression", "ridge", "random_forest", "gradient_boosting", "xgboost", "lightgbm"]
IMPUTERS = ["median", "mean", "knn", "iterative"]
OUTLIERS = ["winsorize", "none"]
ENCODERS = ["onehot", "target", "ordinal"]
SCALERS = ["standard", "robust", "minmax", "none"]
IMBALANCE = ["class_weight", "smote", "none"]

GBT_PRESETS = {
    "gradient_boosting": dict(maxIter=100, maxDepth=3, stepSize=0.1),
    "xgboost": dict(maxIter=100, maxDepth=6, stepSize=0.3, subsamplingRate=1.0),
    "lightgbm": dict(maxIter=100, maxDepth=5, stepSize=0.1, maxBins=255),
}
SEED = 42
RF_TREES = 100
RF_MAX_DEPTH = 12


def plan_params(plan) -> dict:
    raw = plan.get("model_params") or {}
    if isinstance(raw, str):
        raw = json.loads(raw) if raw else {}
    return {k: v for k, v in raw.items() if not str(k).startswith("__")}


#: The earlier name, still imported elsewhere.
_params = plan_params


class _FittedModel(Model, Saved):
    """Wraps a fitted Spark model and normalises its outputs to prediction/probs."""

    SAVED = ("inner", "task", "n_classes")

    def __init__(self, inner, task, n_classes):
        super().__init__()
        self.inner, self.task, self.n_classes = inner, task, n_classes

    def _transform(self, df):
        out = self.inner.transform(df)
        if self.task == "regression":
            return out
        if "probability" in out.columns:
            out = out.withColumn("probs", vector_to_array("probability"))
        else:  # one-vs-rest boosting: normalised sigmoid of the margins
            raw = vector_to_array("rawPrediction")
            sig = F.transform(raw, lambda m: 1 / (1 + F.exp(-m)))
            out = out.withColumn("__sig", sig).withColumn(
                "probs", F.transform("__sig", lambda s: s / F.aggregate("__sig", F.lit(0.0), lambda a, b: a + b))
            ).drop("__sig")
        return out


class ModelStage(Estimator):
    """M-1..M-7: picks the Spark estimator for (model name, task) at fit time.

    Fit-time facts the objective needs (training size, label std, class count)
    come from one small aggregation over the training frame, or are given
    (``facts``: n, wsum, ystd) where they are known already.
    """

    def __init__(self, model, task, params=None, weight_col=None, n_classes=2, smote=False, facts=None):
        super().__init__()
        self.smote, self.facts = smote, facts
        self.model, self.task, self.model_params = model, task, dict(params or {})
        self.weight_col, self.n_classes = weight_col, n_classes
        is_reg = task == "regression"
        valid = REGRESSORS if is_reg else CLASSIFIERS
        known = set(CLASSIFIERS) | set(REGRESSORS)
        if model not in known:
            raise ValueError(f"Unknown model: '{model}'")
        self.valid = model in valid

    def _estimator(self, facts):
        p, is_reg = self.model_params, self.task == "regression"
        wc = {"weightCol": self.weight_col} if self.weight_col else {}
        m = self.model
        if not self.valid:
            raise ValueError(f"Model '{m}' does not support task '{self.task}'")
        if m == "logistic_regression":
            c = float(p.get("C", 1.0))
            n = facts["wsum"]
            return LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False,
                                      maxIter=int(p.get("max_iter", 1000)), tol=1e-6, family="auto", **wc)
        if m == "random_forest":
            kw = dict(numTrees=int(p.get("n_estimators", RF_TREES)), seed=SEED,
                      maxDepth=int(p.get("max_depth") or RF_MAX_DEPTH))
            return RandomForestRegressor(**kw) if is_reg else RandomForestClassifier(**kw, **wc)
        if m in GBT_PRESETS:
            kw = dict(GBT_PRESETS[m])
            if "n_estimators" in p:
                kw["maxIter"] = int(p["n_estimators"])
            if "max_depth" in p:
                kw["maxDepth"] = int(p["max_depth"])
            if "learning_rate" in p:
                kw["stepSize"] = float(p["learning_rate"])
            kw["seed"] = SEED
            if is_reg:
                return GBTRegressor(**kw)
            if self.n_classes > 2:
                return OneVsRest(classifier=GBTClassifier(**kw))
            return GBTClassifier(**kw)
        if m == "linear_regression":
            return LinearRegression(regParam=0.0, solver="normal")
        if m == "ridge":
            alpha = float(p.get("alpha", 1.0))
            return LinearRegression(regParam=alpha * facts["ystd"] / facts["n"], elasticNetParam=0.0,
                                    standardization=False, solver="normal")
        raise ValueError(f"Unknown model: '{m}'")

    def _fit(self, df):
        if self.smote:
            # F-17: oversampling happens inside the fit only, after preprocessing (train rows only)
            from quarry.operators.neighbors import smote

            df = smote(df.select("features", "label"), "label", "features")
        row = self.facts
        if row is None or self.smote:
            w = F.col(self.weight_col) if self.weight_col else F.lit(1.0)
            row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("wsum"), F.stddev_pop("label").alias("ystd")).first()
        facts = {"n": max(row["n"], 1), "wsum": max(row["wsum"] or 1.0, 1e-12), "ystd": row["ystd"] or 0.0}
        est = self._estimator(facts)
        return _FittedModel(est.fit(df), self.task, self.n_classes)


def validate_plan(plan: dict) -> None:
    """F-18 name checks: unknown imputer/scaler/encoder/model names raise ValueError."""
    if plan["imputation"] not in IMPUTERS:
        raise ValueError(f"Unknown imputation strategy: '{plan['imputation']}'")
    if plan["scaling"] not in SCALERS:
        raise ValueError(f"Unknown scaling strategy: '{plan['scaling']}'")
    if plan["encoding"] not in ENCODERS:
        raise ValueError(f"Unknown encoding strategy: '{plan['encoding']}'")
    if plan["model"] not in set(CLASSIFIERS) | set(REGRESSORS):
        raise ValueError(f"Unknown model: '{plan['model']}'")


def build_pipeline(plan: dict, column_types: dict, task: str, n_classes: int = 2,
                   weight_col: str | None = None) -> Pipeline:
    """F-18: plan -> ``pyspark.ml.Pipeline`` over columns typed by the profile.

    ``column_types`` maps feature column -> logical dtype; booleans and
    datetimes are not modelled.  Expects a double ``label`` column.
    """
    validate_plan(plan)
    numeric = [c for c, t in column_types.items() if t == "numeric"]
    categorical = [c for c, t in column_types.items() if t == "categorical"]
    if not numeric and not categorical:
        raise ValueError("No numeric or categorical columns found — cannot build a pipeline.")
    stages = []
    if numeric:
        stages += [FE.InfToNull(numeric), FE.DropEmpty(numeric)]
        imp = plan["imputation"]
        if imp in ("median", "mean"):
            stages.append(FE.SimpleImpute(numeric, imp))
        elif imp == "iterative":
            stages.append(FE.IterativeImpute(numeric))
        else:
            from quarry.operators.neighbors import KnnImpute

            stages.append(KnnImpute(numeric))
        if plan["outlier_handling"] == "winsorize":
            stages.append(FE.Winsorizer(numeric))
        stages.append(FE.DropConstant(numeric))
        if plan["scaling"] != "none":
            stages.append(FE.Scaler(numeric, plan["scaling"]))
    if categorical:
        stages.append(FE.MostFrequentImpute(categorical))
        enc = plan["encoding"]
        if enc == "onehot":
            stages.append(FE.OneHotEncode(categorical))
        elif enc == "ordinal":
            stages.append(FE.OrdinalEncode(categorical))
        else:
            stages.append(FE.TargetEncode(categorical, "label", list(range(n_classes)) if task != "regression" else None))
    stages.append(FE.AssembleFeatures(numeric, categorical))
    smote = plan.get("imbalance_strategy") == "smote" and task != "regression"
    stages.append(ModelStage(plan["model"], task, plan_params(plan), weight_col, n_classes, smote=smote))
    return Pipeline(stages=stages)


def n_steps(column_types: dict) -> int:
    """E-11: column groups present (numeric, categorical) plus one model."""
    vals = set(column_types.values())
    return int("numeric" in vals) + int("categorical" in vals) + 1
