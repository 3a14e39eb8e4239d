"""Run comparison and report tables (O-10 .. O-14, S-10, S-11, E-15 .. E-17).

Everything here reshapes small result frames (attempts, run summaries,
profiles, issues), so each function is a short DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.ranking import dense_codes
from quarry.operators.metrics import BINARY_METRICS, MULTICLASS_METRICS, REGRESSION_METRICS
from quarry.session import checkpoint

ALL_METRICS = list(dict.fromkeys(BINARY_METRICS + MULTICLASS_METRICS + REGRESSION_METRICS))
MISSING_CHART_THRESHOLD = 0.30
TOP_FEATURES = 15


def attempt_history(attempts: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """O-10: one row per attempt, metric map flattened to columns, score desc, 4 dp."""
    names = metrics or ALL_METRICS
    cols = [c for c in ("iteration", "plan_id", "imputation", "outlier_handling", "encoding", "scaling", "model",
                        "imbalance_strategy") if c in attempts.columns]
    return attempts.select(
        *cols,
        F.round("score", 4).alias("score"),
        F.round("cv_std", 4).alias("cv_std"),
        *[F.round(F.col("metric_values")[m], 4).alias(m) for m in names],
    ).orderBy(F.desc("score"))


def best_per_run(log: DataFrame) -> DataFrame:
    """O-11: attempts per run and the best attempt (max score, earliest on ties)."""
    return log.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_attempts"),
        F.max_by(F.struct("plan_id", "model", "score", "iteration"), F.struct("score", -F.col("iteration"))).alias("best"),
    ).select("run_id", "n_attempts", "best.*")


def compare_variants(*summaries: DataFrame) -> DataFrame:
    """O-12: ablation table — run summaries stacked, missing columns as NULL."""
    out = summaries[0]
    for s in summaries[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def warm_start_delta(first: DataFrame, second: DataFrame) -> DataFrame:
    """O-13: second run minus first run in score and iterations (1-row inputs)."""
    a = first.select(F.col("score").alias("score_1"), F.col("n_iterations").alias("iter_1"), F.lit(1).alias("__k"))
    b = second.select(F.col("score").alias("score_2"), F.col("n_iterations").alias("iter_2"), F.lit(1).alias("__k"))
    return a.join(b, "__k").select(
        "score_1", "score_2", (F.col("score_2") - F.col("score_1")).alias("score_delta"),
        "iter_1", "iter_2", (F.col("iter_2") - F.col("iter_1")).alias("iteration_delta"),
    )


def dataset_summary(columns: DataFrame, table: DataFrame, issues: DataFrame) -> DataFrame:
    """O-14 / S-10: one row of dataset facts, issue counts by severity, 4 dp.

    ``columns``: profile_columns frame; ``table``: 1-row DataProfile frame;
    ``issues``: issues frame.
    """
    col = columns.agg(
        F.count(F.lit(1)).alias("n_cols"),
        F.count_if(F.col("dtype") == "numeric").alias("n_numeric"),
        F.count_if(F.col("dtype") == "categorical").alias("n_categorical"),
        F.round(F.avg("missing_rate"), 4).alias("avg_missing_rate"),
        F.round(F.max("missing_rate"), 4).alias("max_missing_rate"),
    ).withColumn("__k", F.lit(1))
    iss = issues.agg(
        F.count_if(F.col("severity") == "high").alias("n_high"),
        F.count_if(F.col("severity") == "medium").alias("n_medium"),
        F.count_if(F.col("severity") == "low").alias("n_low"),
    ).withColumn("__k", F.lit(1))
    tab = table.select("n_rows", "target_column", "target_type", F.round("duplicate_rate", 4).alias("duplicate_rate")).withColumn(
        "__k", F.lit(1))
    return tab.join(col, "__k").join(iss, "__k").drop("__k")


def run_summary_row(dataset: DataFrame, run: DataFrame) -> DataFrame:
    """S-10: dataset summary + best plan and rounded metrics, one row."""
    r = run.select(
        "method", "best_plan", F.round("score", 4).alias("score"), F.round("cv_std", 4).alias("cv_std"),
        F.transform_values("metric_values", lambda k, v: F.round(v, 4)).alias("metric_values"),
        "n_iterations", "converged",
    ).withColumn("__k", F.lit(1))
    return dataset.withColumn("__k", F.lit(1)).join(r, "__k").drop("__k")


def report_facts(sections: dict[str, DataFrame]) -> DataFrame:
    """S-11: (section, ord, key, value) facts from named frames; NULL and NaN values are skipped.

    ``ord`` counts the rows of a section from 0 in the frame's order; values
    are in Spark's text form.  Sections of any size stay DataFrames: one union,
    numbered by one distributed sort.
    """
    parts = []
    for i, (name, df) in enumerate(sections.items()):
        facts = [
            F.struct(F.lit(c).alias("key"), (F.nanvl(F.col(f"`{c}`"), F.lit(None)) if t in ("double", "float") else F.col(f"`{c}`")).cast("string").alias("value"))
            for c, t in df.dtypes
        ]
        at = F.struct(F.lit(i).alias("section_no"), F.monotonically_increasing_id().alias("row"))
        parts.append(df.select(F.lit(name).alias("section"), at.alias("at"), F.array(*facts).alias("facts")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return _numbered(checkpoint(rows)).select("section", "ord", F.explode("facts").alias("fact")).select("section", "ord", "fact.*").where("value is not null")


def _numbered(rows: DataFrame) -> DataFrame:
    coded = rows.join(dense_codes(rows, "at", "code"), "at")
    first = coded.groupBy("section").agg(F.min("code").alias("first"))
    return coded.join(first, "section").withColumn("ord", (F.col("code") - F.col("first")).cast("int"))


def run_facts(result, clusters=None, cluster_summary: DataFrame | None = None, spark=None) -> DataFrame:
    """S-11 for one run: overview, classes, issues, clusters, strategy, performance and questions.

    ``result`` has ``profile``, ``issues`` and ``questions`` and, for a
    predictive run, the best plan and its metrics.  Absent parts have no rows.
    """
    get = result.get if isinstance(result, dict) else lambda name, default=None: getattr(result, name, default)
    prof, issues, questions = get("profile"), get("issues"), get("questions")
    spark = spark or (issues if issues is not None else get("attempts")).sparkSession
    table = prof.to_frame(spark)
    sections = {"overview": table.select("n_rows", "n_cols", "target_column", "target_type", "n_duplicates")}
    if prof.class_distribution:
        sections["class_distribution"] = table.select(F.explode("class_distribution").alias("class", "share")).orderBy("class")
    if issues is not None:
        sections["quality"] = issues.agg(F.count(F.lit(1)).alias("n_issues"), F.count_if(F.col("severity") == "high").alias("n_high"), F.count_if(F.col("severity") == "medium").alias("n_medium"))
        for severity in ("high", "medium"):
            sections[f"issues_{severity}"] = issues.where(F.col("severity") == severity)
    if clusters is not None and clusters.labels is not None:
        sections["cluster_quality"] = clusters.quality(spark)
        if cluster_summary is not None:
            sections["clusters"] = cluster_summary.orderBy("cluster", "rank")
    plan = get("best_plan")
    if plan:
        keys = [k for k in plan if plan[k] is not None]
        sections["strategy"] = spark.createDataFrame([tuple(str(plan[k]) for k in keys)], ", ".join(f"`{k}` string" for k in keys))
        values = {**(get("metric_values") or {}), "cv_std": get("cv_std"), "composite": get("score")}
        values |= {f"test_{k}": v for k, v in (get("test_metrics") or {}).items() if v is not None}
        scores = spark.createDataFrame([(k, float(v)) for k, v in values.items()], "metric string, value double")
        sections["performance"] = scores.select("metric", F.round("value", 4).alias("value"))
    if questions is not None:
        sections["questions"] = questions
    return report_facts(sections)


def missingness_chart(columns: DataFrame) -> DataFrame:
    """E-15: columns with any missing values, with the 0.30 marker."""
    return columns.where(F.col("missing_rate") > 0).select(
        "column", "missing_rate", F.lit(MISSING_CHART_THRESHOLD).alias("threshold"),
        (F.col("missing_rate") >= MISSING_CHART_THRESHOLD).alias("above_threshold"),
    ).orderBy(F.desc("missing_rate"))


def feature_importance(model, scored: DataFrame, top: int = TOP_FEATURES) -> DataFrame | None:
    """E-16: the ``top`` largest importances of a fitted tree pipeline, with slot names.

    ``scored`` is any frame the pipeline produced (its ``features`` column
    carries the ML attribute metadata naming each vector slot).  Returns None
    for models without importances (linear models).
    """
    from quarry.operators.features import _OneHotModel
    from quarry.operators.models import _FittedModel

    inner = next((s.inner for s in model.stages if isinstance(s, _FittedModel)), None)
    if inner is None or not hasattr(inner, "featureImportances"):
        return None
    imp = inner.featureImportances.toArray().tolist()
    names = {i: f"f{i}" for i in range(len(imp))}
    attrs = scored.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    for group in attrs.values():
        for a in group:
            names[a["idx"]] = a.get("name", names.get(a["idx"]))
    rows = sorted(((names[i], float(v)) for i, v in enumerate(imp)), key=lambda t: -t[1])[:top]
    hot = next((s for s in model.stages if isinstance(s, _OneHotModel)), None)
    for c in hot.cols if hot else ():  # slots carry codes; only those of the top are looked up
        place = {int(n.rsplit("_", 1)[1]): n for n, _ in rows if n.startswith(f"{c}__enc_") and n.rsplit("_", 1)[1].isdigit()}
        if place:
            found = hot.tables[c].where(F.col("__code").isin(list(place))).collect()
            label = {place[r["__code"]]: f"{c}__enc_{r['__v']}" for r in found}
            rows = [(label.get(n, n), v) for n, v in rows]
    return scored.sparkSession.createDataFrame(rows, "feature string, importance double")


def actual_vs_predicted(preds: DataFrame) -> DataFrame:
    """E-17: out-of-fold (label, prediction) pairs plus the common axis range."""
    rng = preds.agg(F.least(F.min("label"), F.min("prediction")).alias("lo"),
                    F.greatest(F.max("label"), F.max("prediction")).alias("hi")).withColumn("__k", F.lit(1))
    return preds.select("fold", "label", "prediction", F.lit(1).alias("__k")).join(rng, "__k").drop("__k")
