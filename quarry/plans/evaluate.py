"""Cross-validated evaluation of plans (E-4, E-10 .. E-14).

For each plan and fold the preprocessing and the model of the other folds are
applied to the held-out fold.  The preprocessing of all folds comes from one
grouped count (:mod:`quarry.plans.fold_fit`) or, for imputers that need whole
rows, from a fresh pipeline inside each fold.  Fold
predictions are unioned into one frame, metrics are computed per fold from
that frame with the jobs in ``operators.metrics``, and a failing plan is
recorded with score -inf and its error text without stopping the others.

The fold-tagged training frame is persisted (reused plans x folds times) and
released at the end.
"""

from __future__ import annotations

import time

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.features import class_weight_column
from quarry.operators.folds import CROSS_COLUMN, assign_folds, cross_folds
from quarry.operators.metrics import (
    BINARY_METRICS,
    MULTICLASS_METRICS,
    PRIMARY,
    REGRESSION_METRICS,
    composite_score,
    fold_average,
    task_metrics,
)
from quarry.operators.models import ModelStage, build_pipeline, n_steps, plan_params, validate_plan
from quarry.plans.fold_fit import FoldFits
from quarry.session import checkpoint

ATTEMPT_SCHEMA = (
    "plan_id string, imputation string, outlier_handling string, encoding string, scaling string, "
    "model string, imbalance_strategy string, model_params string, score double, "
    "metric_values map<string,double>, cv_std double, runtime_secs double, error string, position int"
)
PLAN_FIELDS = ["plan_id", "imputation", "outlier_handling", "encoding", "scaling", "model", "imbalance_strategy"]


def label_index(df: DataFrame, target: str, task: str):
    """Adds a double ``label``; classification classes are the sorted distinct values.

    Returns (frame, classes).  The class list is bounded by the class count.
    """
    if task == "regression":
        return df.withColumn("label", F.col(f"`{target}`").cast("double")), None
    dt = df.schema[target].dataType.simpleString()
    numeric = dt in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or dt.startswith("decimal")
    vals = [r[0] for r in df.select(F.col(f"`{target}`").alias("v")).where("v is not null").distinct().collect()]
    classes = sorted(vals, key=lambda v: (float(v) if numeric else str(v)))
    mapping = df.sparkSession.createDataFrame([(c, float(i)) for i, c in enumerate(classes)], ["__cls", "label"])
    tdf = df.join(F.broadcast(mapping), F.col(f"`{target}`") == F.col("__cls")).drop("__cls")
    return tdf, classes


def weighted(plan: dict, task: str) -> bool:
    """Whether the plan's model is fitted with class weights."""
    return plan.get("imbalance_strategy") == "class_weight" and task != "regression" and plan["model"] in (
        "logistic_regression", "random_forest", "lightgbm")


def shared_fit(fits: FoldFits, plan: dict, task: str, n_classes: int, i: int) -> PipelineModel:
    """Preprocessing of training set ``i`` from the shared statistics, and the model fitted on it."""
    validate_plan(plan)
    prep = fits.preprocessing(plan, i)
    train = prep.transform(fits.df.where(F.col("fold") != i))
    weight = None
    if weighted(plan, task):
        weight = "weight"
        pairs = [F.lit(float(x)) for cell in sorted(fits.class_weights()[i].items()) for x in cell]
        train = train.withColumn(weight, F.create_map(*pairs)[F.col("label")])
    smote = plan.get("imbalance_strategy") == "smote" and task != "regression"
    n, ystd = fits.label_facts()[i]
    facts = {"n": n, "wsum": float(n), "ystd": ystd}  # balanced weights sum to the number of rows
    stage = ModelStage(plan["model"], task, plan_params(plan), weight, n_classes, smote=smote, facts=facts)
    return PipelineModel([*prep.stages, stage.fit(train.select("features", "label", *([weight] if weight else [])))])


def cv_predictions(df: DataFrame, plan: dict, column_types: dict, task: str, classes, k: int,
                   parallelism: int | None = None, fits: FoldFits | None = None) -> DataFrame:
    """E-4: union of held-out predictions ``(fold, label, prediction[, score|probs])``.

    With ``fits`` the preprocessing of all folds comes from statistics counted
    once (:mod:`quarry.plans.fold_fit`), and only the models are fitted fold by
    fold; plans it does not handle refit every stage inside each fold.  Model
    fits are independent Spark jobs; like ``CrossValidator(parallelism)``
    they are submitted from a small driver thread pool so the cluster is not
    idle between the short jobs of one fit.
    """
    n_classes = len(classes) if classes else 2
    shared = fits is not None and fits.handles(plan)
    if shared:
        validate_plan(plan)
        fits.preprocessing(plan, 0)  # the statistics, before the threads ask for them

    def one(i):
        test = df.where(F.col("fold") == i).drop(CROSS_COLUMN)
        if shared:
            model = shared_fit(fits, plan, task, n_classes, i)
        else:
            train = df.where(F.col("fold") != i)
            weight = None
            if weighted(plan, task):
                train = class_weight_column(train, "label", "weight")
                weight = "weight"
            model = build_pipeline(plan, column_types, task, n_classes, weight).fit(train)
        pred = model.transform(test)
        cols = [F.lit(i).alias("fold"), "label", "prediction"]
        if task == "binary":
            cols.append(F.col("probs")[1].alias("score"))
        elif task == "multiclass":
            cols.append("probs")
        return pred.select(*cols)

    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=parallelism or k) as pool:
        parts = list(pool.map(inheritable_thread_target(df.sparkSession)(one), range(k)))  # fits carry the caller's job tags
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Training:
    """The labelled, fold-tagged frame of one target with its shared statistics; a context manager.

    Plans evaluated on it, and the refit of the best one, read the same counts.
    """

    def __init__(self, df: DataFrame, target: str, key: list[str], task: str, column_types: dict, cv: int = 5, seed: int = 42):
        self.feats = {c: t for c, t in column_types.items() if c != target and c not in key}
        self.task, self.cv = task, cv
        lab, self.classes = label_index(df.where(F.col(f"`{target}`").isNotNull()), target, task)
        folded = cross_folds(assign_folds(lab, key, "label", task, cv, seed), key)
        self.folded = folded.persist(StorageLevel.MEMORY_AND_DISK)
        self.n_classes = len(self.classes) if self.classes else 2
        self.fits = FoldFits(self.folded, self.feats, task, self.n_classes, cv)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.fits.close()
        self.folded.unpersist()

    def refit(self, plan: dict) -> PipelineModel | None:
        """M-8 from the shared statistics, or None where the plan needs a pipeline of its own."""
        return shared_fit(self.fits, plan, self.task, self.n_classes, self.cv) if self.fits.handles(plan) else None


def evaluate_plans(df: DataFrame, plans: list[dict], target: str, key: list[str], task: str,
                   column_types: dict, cv: int = 5, seed: int = 42, training: Training | None = None) -> DataFrame:
    """E-13: evaluate every plan; returns the attempts frame (one row per plan, in order)."""
    if training is None:
        with Training(df, target, key, task, column_types, cv, seed) as own:
            return evaluate_plans(df, plans, target, key, task, column_types, cv, seed, own)
    spark = df.sparkSession
    feats, classes, folded, fits = training.feats, training.classes, training.folded, training.fits
    rows = []
    for pos, plan in enumerate(plans):
        t0 = time.perf_counter()
        err = preds = None
        try:
            preds = cv_predictions(folded, plan, feats, task, classes, cv, fits=fits).persist(StorageLevel.MEMORY_AND_DISK)
            per_fold = task_metrics(preds, ["fold"], task, classes=list(range(len(classes))) if classes else None,
                                    **({"score": "score"} if task == "binary" else {}))
            summary = fold_average(per_fold.withColumn("__all", F.lit(1)), ["__all"], task).first().asDict()
            names = {"binary": BINARY_METRICS, "multiclass": MULTICLASS_METRICS, "regression": REGRESSION_METRICS}[task]
            metrics = {m: summary[m] for m in names if summary[m] is not None}
            cv_std = summary["cv_std"] or 0.0
            primary = summary[PRIMARY[task]]
            steps = n_steps(feats)
            score = primary - 0.5 * cv_std - 0.01 * steps
        except Exception as e:  # noqa: BLE001 - failure isolation is the contract
            err = f"{type(e).__name__}: {e}"[:2000]
            metrics, cv_std, score = {}, 0.0, float("-inf")
        finally:
            if preds is not None:
                preds.unpersist()
        runtime = time.perf_counter() - t0
        rows.append(_attempt_row(plan, score, metrics, cv_std, runtime, err, pos))
    return spark.createDataFrame(rows, ATTEMPT_SCHEMA)


def _attempt_row(plan, score, metrics, cv_std, runtime, err, pos):
    import json

    params = plan.get("model_params") or {}
    if not isinstance(params, str):
        params = json.dumps(params, sort_keys=True)
    return (
        str(plan.get("plan_id")), plan["imputation"], plan["outlier_handling"], plan["encoding"], plan["scaling"],
        plan["model"], plan.get("imbalance_strategy", "none"), params, float(score),
        {k: float(v) for k, v in metrics.items()}, float(cv_std), float(runtime), err, pos,
    )


def out_of_fold(df: DataFrame, plan: dict, target: str, key: list[str], task: str, column_types: dict,
                k: int = 3, seed: int = 42) -> DataFrame:
    """E-17: out-of-fold predictions of one plan with k folds (chart data)."""
    with Training(df, target, key, task, column_types, k, seed) as t:
        # the predictions leave the persisted statistics behind
        return checkpoint(cv_predictions(t.folded, plan, t.feats, task, t.classes, k, fits=t.fits))


def select_best(attempts: DataFrame) -> DataFrame:
    """E-14: the highest-scoring non-failed attempt (1 row); raises if none succeeded."""
    ok = attempts.where(F.col("error").isNull() & (F.col("score") > F.lit(float("-inf"))))
    best = ok.agg(F.max_by(F.struct(*attempts.columns), F.struct(F.col("score"), -F.col("position"))).alias("b")).select("b.*")
    if best.where(F.col("plan_id").isNotNull()).take(1) == []:
        raise ValueError("No successful evaluation results to select from")
    return best


def composite(primary, cv_std, steps):
    return composite_score(primary, cv_std, steps)
