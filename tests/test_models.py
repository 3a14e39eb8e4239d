import numpy as np
from pyspark.sql import functions as F

from quarry.plans.evaluate import evaluate_plans, select_best


def _binary(spark, n=100):
    rows = []
    for i in range(n):
        age = 20.0 + (i * 7) % 40
        income = 20000.0 + (i * 1337) % 50000
        city = ["a", "b", "c"][i % 3]
        target = 1 if age + income / 5000 > 45 else 0
        rows.append((i, None if i % 33 == 0 else age, income, None if i % 50 == 1 else city, target))
    return spark.createDataFrame(rows, "id int, age double, income double, city string, target int")


TYPES = {"id": "numeric", "age": "numeric", "income": "numeric", "city": "categorical", "target": "numeric"}


def plan(**kw):
    p = dict(plan_id="p", imputation="median", outlier_handling="none", encoding="onehot", scaling="standard",
             model="logistic_regression", imbalance_strategy="none")
    p.update(kw)
    return p


def test_option_matrix_smoke(spark):
    df = _binary(spark)
    plans = [
        plan(plan_id="mean_robust_ordinal", imputation="mean", scaling="robust", encoding="ordinal"),
        plan(plan_id="winsor_minmax_target", outlier_handling="winsorize", scaling="minmax", encoding="target"),
        plan(plan_id="iter_rf_weight", imputation="iterative", model="random_forest", imbalance_strategy="class_weight",
             model_params={"n_estimators": 10}),
        plan(plan_id="gbt", model="gradient_boosting", model_params={"n_estimators": 5}),
        plan(plan_id="wrong_task", model="ridge"),
    ]
    att = evaluate_plans(df, plans, "target", ["id"], "binary", TYPES, cv=3)
    res = {r["plan_id"]: r for r in att.collect()}
    for pid in ("mean_robust_ordinal", "winsor_minmax_target", "iter_rf_weight", "gbt"):
        assert res[pid]["error"] is None, res[pid]["error"]
        assert np.isfinite(res[pid]["score"]) and "f1_macro" in res[pid]["metric_values"]
    assert res["wrong_task"]["score"] == float("-inf") and res["wrong_task"]["error"]
    best = select_best(att).first()
    assert best["plan_id"] != "wrong_task"


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(80, 2))
    y = 3 * X[:, 0] - X[:, 1] + rng.normal(scale=0.1, size=80)
    rows = [(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(X, y))]
    df = spark.createDataFrame(rows, "id int, x1 double, x2 double, price double")
    from quarry.operators.models import ModelStage
    from pyspark.ml.feature import VectorAssembler

    va = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(df.withColumn("label", F.col("price")))
    m = ModelStage("ridge", "regression").fit(va).inner
    Xc = X - X.mean(0)
    yc = y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + 1.0 * np.eye(2), Xc.T @ yc)
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-6)
