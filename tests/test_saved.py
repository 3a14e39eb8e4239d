"""Fitted plans survive saving, and runs assemble their report facts."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from quarry.operators.models import build_pipeline
from quarry.plans.compare import report_facts
from quarry.plans.runs import run_exploratory


def _rows(spark, n=60):
    rows = [(i, None if i % 9 == 0 else float(i % 17), float(i * 7 % 23), ["x", "y", "z"][i % 3], float(i % 17 + i * 7 % 23 > 18)) for i in range(n)]
    return spark.createDataFrame(rows, "id int, a double, b double, c string, label double")


@pytest.mark.parametrize("imputation,scaling,encoding", [("median", "robust", "onehot"), ("iterative", "minmax", "ordinal"), ("knn", "none", "target")])
def test_saved_plan_predicts_the_same(spark, scratch, imputation, scaling, encoding):
    df = _rows(spark)
    plan = dict(plan_id="p", imputation=imputation, outlier_handling="winsorize", encoding=encoding, scaling=scaling, model="logistic_regression", imbalance_strategy="none")
    model = build_pipeline(plan, {"a": "numeric", "b": "numeric", "c": "categorical"}, "binary").fit(df)
    model.write().save(f"{scratch}/model")
    again = PipelineModel.load(f"{scratch}/model")
    got = [{r["id"]: (r["prediction"], r["probs"]) for r in m.transform(df).collect()} for m in (model, again)]
    assert got[0] == got[1] and len(got[0]) == 60
    assert [s.uid for s in model.stages] == [s.uid for s in again.stages]


def test_report_facts_number_rows_and_skip_missing(spark):
    a = spark.createDataFrame([(1, None, float("nan")), (2, "u", 0.5)], "k int, s string, d double").coalesce(1)
    b = spark.range(25).repartition(5).select("id").orderBy("id")
    facts = {(r["section"], r["ord"], r["key"]): r["value"] for r in report_facts({"a": a, "b": b, "none": b.limit(0)}).collect()}
    assert {k: v for k, v in facts.items() if k[0] == "a"} == {("a", 0, "k"): "1", ("a", 1, "k"): "2", ("a", 1, "s"): "u", ("a", 1, "d"): "0.5"}
    assert [facts["b", i, "id"] for i in range(25)] == [str(i) for i in range(25)] and len(facts) == 29


def test_exploratory_run_has_facts(spark):
    df = _rows(spark, 40).withColumn("label", F.col("label").cast("int"))
    facts = {(r["section"], r["key"]): r["value"] for r in run_exploratory(df, ["id"], method="kmeans")["facts"].collect()}
    assert facts["overview", "n_rows"] == "40" and facts["quality", "n_issues"] is not None and ("cluster_quality", "silhouette") in facts
