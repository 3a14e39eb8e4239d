from pyspark.sql import functions as F

from quarry.plans.compare import attempt_history, best_per_run, compare_variants, report_facts, warm_start_delta
from quarry.plans.runs import run_budgeted_search, run_exploratory, run_predictive, run_random_search
from quarry.sources.attempt_log import AttemptLog
from quarry.sources.plan_memory import PlanMemory


def _df(spark, n=120):
    rows = []
    for i in range(n):
        a = float(i % 17)
        b = float((i * 7) % 23)
        rows.append((i, a, b, ["x", "y", "z"][i % 3], 1 if a + b / 2 > 12 else 0))
    return spark.createDataFrame(rows, "id int, a double, b double, c string, target int")


def cheap(issues, history, memory, task, n, round_no):
    spark = issues.sparkSession
    rows = [(f"r{round_no}_{i}", imp, "none", "onehot", sc, "logistic_regression", "none", "{}")
            for i, (imp, sc) in enumerate([("median", "standard"), ("mean", "minmax"), ("median", "robust")][:n])]
    return spark.createDataFrame(rows, "plan_id string, imputation string, outlier_handling string, encoding string, "
                                       "scaling string, model string, imbalance_strategy string, model_params string")


def test_loop_converges_at_threshold_zero(spark, scratch):
    r = run_predictive(_df(spark), "target", ["id"], cv=3, score_threshold=0.0, proposer=cheap,
                       log_path=scratch + "/log", memory_path=scratch + "/mem")
    assert r.converged and r.n_iterations == 1
    assert AttemptLog(spark, scratch + "/log").load(r.run_id).count() == 3
    assert PlanMemory(spark, scratch + "/mem").count() == 1


def test_loop_stops_without_convergence(spark, scratch):
    r = run_predictive(_df(spark), "target", ["id"], cv=3, score_threshold=1.0, max_rounds=2, n_plans=2,
                       proposer=cheap, log_path=scratch + "/log", memory_path=scratch + "/mem", use_memory=False)
    assert not r.converged and r.n_iterations == 2
    assert AttemptLog(spark, scratch + "/log").load(r.run_id).count() == 4
    assert PlanMemory(spark, scratch + "/mem").count() == 0
    hist = attempt_history(r.attempts).collect()
    assert [h["score"] for h in hist] == sorted([h["score"] for h in hist], reverse=True)
    log = AttemptLog(spark, scratch + "/log").all()
    assert best_per_run(log).first()["n_attempts"] == 4


def test_random_and_budgeted_search(spark):
    r = run_random_search(_df(spark), "target", ["id"], n_trials=2, cv=3)
    assert r.n_configs_evaluated == 2 and r.test_metrics is not None
    b = run_budgeted_search(_df(spark), "target", ["id"], budget_s=0.0, cv=3)
    assert b.n_configs_evaluated >= 1
    table = compare_variants(r.summary(spark), b.summary(spark))
    assert table.count() == 2
    d = warm_start_delta(r.summary(spark), b.summary(spark)).first()
    assert abs(d["score_delta"] - (b.score - r.score)) < 1e-12


def test_exploratory_run(spark):
    out = run_exploratory(_df(spark), ["id"], goal="find groups")
    assert out["issues"] is not None and out["profile"].target is None
    facts = report_facts({"issues": out["issues"].select("issue_type", "severity")})
    assert facts.where(F.col("section") == "issues").count() >= 0


def test_feature_importance_names(spark):
    from quarry.operators.models import build_pipeline
    from quarry.plans.compare import feature_importance

    df = _df(spark).withColumn("label", F.col("target").cast("double"))
    plan = dict(plan_id="rf", imputation="median", outlier_handling="none", encoding="onehot", scaling="none",
                model="random_forest", imbalance_strategy="none", model_params={"n_estimators": 5})
    m = build_pipeline(plan, {"a": "numeric", "b": "numeric", "c": "categorical"}, "binary").fit(df)
    fi = feature_importance(m, m.transform(df)).collect()
    names = [r["feature"] for r in fi]
    assert all(not n.rsplit("_", 1)[1].isdigit() for n in names if n.startswith("c__enc_"))
    assert "a" in names and "b" in names and all(not n.startswith("f") or n.startswith("f") and n in ("a", "b") for n in names[:2])


def test_run_from_goal_routes(spark):
    import pytest
    from quarry.plans.runs import run_from_goal

    df = _df(spark)
    mode, task, out = run_from_goal(df, "explore natural groups in this table", ["id"])
    assert mode == "exploratory" and out["issues"] is not None
    mode, task, res = run_from_goal(df, "predict target from a and b", ["id"], cv=3, max_rounds=1, n_plans=1,
                                    proposer=cheap)
    assert mode == "predictive" and task["target"] == "target" and res.n_iterations == 1
    with pytest.raises(ValueError):
        run_from_goal(df.drop("target"), "predict the weather tomorrow", ["id"])
