import json

import pytest
from pyspark.sql import functions as F

from quarry.plans.evaluate import select_best
from quarry.plans.space import propose, rule_plan, sample_plans, search_space, validate_proposals

ISSUE_COLS = "issue_type string, severity string, affected_column string, evidence map<string,double>"


def issues(spark, rows):
    return spark.createDataFrame(rows, ISSUE_COLS)


def test_search_space_sizes(spark):
    assert search_space(spark, "binary").count() == 1440
    assert search_space(spark, "regression").count() == 576
    s = sample_plans(search_space(spark, "binary"), 50).collect()
    assert len(s) == 50 and len({r["plan_id"] for r in s}) == 50
    assert [r["plan_id"] for r in s] == [r["plan_id"] for r in sample_plans(search_space(spark, "binary"), 50).collect()]


def test_rule_plan(spark):
    iss = issues(spark, [("high_missingness", "high", "a", {"missing_rate": 0.4}),
                         ("outliers", "high", "b", {"outlier_rate": 0.075}),
                         ("class_imbalance", "medium", "t", {"minority_rate": 0.15})])
    p = rule_plan(iss, "binary").first()
    assert (p["imputation"], p["outlier_handling"], p["scaling"], p["imbalance_strategy"], p["model"]) == (
        "knn", "winsorize", "robust", "class_weight", "logistic_regression")
    clean = rule_plan(issues(spark, []), "regression").first()
    assert (clean["imputation"], clean["scaling"], clean["model"], clean["imbalance_strategy"]) == (
        "median", "standard", "ridge", "none")


def test_propose_never_repeats_and_varies_models(spark):
    iss = issues(spark, [("high_missingness", "high", "a", {"missing_rate": 0.5})])
    first = propose(iss, None, None, "binary", n=3)
    rows = first.collect()
    assert len({r["model"] for r in rows}) == 3
    assert all(r["imputation"] in ("knn", "iterative") for r in rows)
    second = propose(iss, first, None, "binary", n=3, round_no=2).collect()
    key = lambda r: (r["model"], r["imputation"], r["encoding"], r["scaling"])
    assert not ({key(r) for r in rows} & {key(r) for r in second})


def test_propose_warm_start(spark):
    mem = spark.createDataFrame([("m", "mean", "none", "ordinal", "minmax", "random_forest", "none", "{}")],
                                "plan_id string, imputation string, outlier_handling string, encoding string, "
                                "scaling string, model string, imbalance_strategy string, model_params string")
    top = propose(issues(spark, []), None, mem, "binary", n=3).first()
    assert (top["model"], top["imputation"], top["encoding"], top["scaling"]) == ("random_forest", "mean", "ordinal", "minmax")


def test_validate_proposals(spark):
    good = {"plans": [{"imputation": "median", "outlier_handling": "none", "encoding": "onehot", "scaling": "standard",
                       "model": "random_forest", "imbalance_strategy": "none", "model_params": {"max_depth": 4},
                       "plain_language_explanation": "simple"}] * 5, "reasoning": "r"}
    missing = {"plans": [{"imputation": "median"}]}
    docs = spark.createDataFrame([(1, json.dumps(good)), (2, "not json"), (3, json.dumps(missing)),
                                  (4, json.dumps({"plans": []}))], "doc_id int, doc string")
    acc, rej = validate_proposals(docs, 2)
    a = acc.collect()
    assert len(a) == 2 and len({r["plan_id"] for r in a}) == 2
    assert json.loads(a[0]["model_params"])["__explanation"] == "simple"
    from quarry.operators.models import _params

    assert _params({"model_params": a[0]["model_params"]}) == {"max_depth": "4"}
    reasons = {r["doc_id"]: r["reason"] for r in rej.collect()}
    assert reasons[2] == "invalid_json" and reasons[3].startswith("plan 0 missing fields") and reasons[4] == "zero_plans"


def test_select_best(spark):
    rows = [("a", 0.80, None, 0), ("b", 0.91, None, 1), ("c", 0.75, None, 2), ("d", float("-inf"), "boom", 3)]
    att = spark.createDataFrame(rows, "plan_id string, score double, error string, position int")
    assert select_best(att).first()["plan_id"] == "b"
    with pytest.raises(ValueError):
        select_best(att.where(F.col("plan_id") == "d"))
