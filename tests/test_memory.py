from pyspark.sql import functions as F

from quarry.sources.attempt_log import AttemptLog
from quarry.sources.plan_memory import PlanMemory
from quarry.sources.readers import load_table

import pytest

ATT = ("plan_id string, imputation string, outlier_handling string, encoding string, scaling string, model string, "
       "imbalance_strategy string, model_params string, score double, metric_values map<string,double>, cv_std double, "
       "runtime_secs double, error string, position int")


def attempts(spark, pid, score):
    return spark.createDataFrame([(pid, "median", "none", "onehot", "standard", "logistic_regression", "none",
                                   '{"C": 1.0}', score, {"f1": score, "auc": 0.9}, 0.01, 1.5, None, 0)], ATT)


def test_attempt_log_round_trip_isolation_and_order(spark, scratch):
    log = AttemptLog(spark, scratch + "/log")
    assert log.load("nope").count() == 0
    log.append("run1", 2, attempts(spark, "p2", 0.7))
    log.append("run1", 1, attempts(spark, "p1", 0.6))
    log.append("run2", 1, attempts(spark, "q1", 0.5))
    rows = log.load("run1").collect()
    assert [r["plan_id"] for r in rows] == ["p1", "p2"]
    assert rows[0]["metric_values"]["auc"] == 0.9 and rows[0]["model_params"] == '{"C": 1.0}'
    assert [r["run_id"] for r in log.runs().collect()] == ["run1", "run2"]


def test_a_retried_round_is_stored_once(spark, scratch):
    log = AttemptLog(spark, scratch + "/log")
    first = attempts(spark, "p1", 0.6).unionByName(attempts(spark, "p2", 0.5))
    log.append("run/1 =x", 1, first)
    log.append("run/1 =x", 2, attempts(spark, "p3", 0.7))
    log.append("other", 1, attempts(spark, "q1", 0.1))
    log.append("run/1 =x", 1, attempts(spark, "p1", 0.65))
    log.append("run/1 =x", 2, first.limit(0))
    assert [(r["iteration"], r["plan_id"], r["score"]) for r in log.load("run/1 =x").collect()] == [(1, "p1", 0.65), (2, "p3", 0.7)]
    assert log.all().count() == 3 and log.load("other").count() == 1


def test_plan_memory_top_k(spark, scratch):
    mem = PlanMemory(spark, scratch + "/mem")
    assert mem.count() == 0 and mem.similar([1.0] * 8).count() == 0
    e1 = [1.0] + [0.0] * 7
    e8 = [0.0] * 7 + [1.0]
    mem.append(e1, {"plan_id": "x", "model": "ridge"}, "d1")
    mem.append(e8, {"plan_id": "y", "model": "random_forest"}, "d2")
    mem.append(e1, {"plan_id": "z", "model": "ridge"}, "d3")
    assert mem.count() == 3
    top = mem.similar(e8, k=2).collect()
    assert top[0]["plan"]["plan_id"] == "y" and abs(top[0]["similarity"] - 1.0) < 1e-12
    assert len(mem.similar(e1, k=5).collect()) == 3


def test_loader_dispatch(spark, scratch):
    df = spark.createDataFrame([(1, "a")], "x int, s string")
    df.write.mode("overwrite").option("header", True).csv(scratch + "/t.csv")
    df.write.mode("overwrite").parquet(scratch + "/t.parquet")
    assert load_table(spark, scratch + "/t.csv").first()["x"] == 1
    assert load_table(spark, scratch + "/t.parquet").count() == 1
    with pytest.raises(ValueError):
        load_table(spark, scratch + "/t.json")
