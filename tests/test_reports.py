from pyspark.sql import functions as F

from quarry.operators.issues import detect_issues
from quarry.operators.prep import preview
from quarry.operators.profile import profile
from quarry.plans.compare import actual_vs_predicted, dataset_summary, missingness_chart, run_summary_row
from quarry.plans.evaluate import out_of_fold
from quarry.sources.readers import load_table, write_csv


def _reg(spark, n=90):
    rows = [(i, float(i % 13), float((i * 5) % 17), 3.0 * (i % 13) + 0.5 * ((i * 5) % 17)) for i in range(n)]
    return spark.createDataFrame(rows, "id int, a double, b double, y double")


def test_out_of_fold_and_actual_vs_predicted(spark):
    df = _reg(spark)
    plan = dict(plan_id="lin", imputation="median", outlier_handling="none", encoding="onehot", scaling="none",
                model="linear_regression", imbalance_strategy="none")
    oof = out_of_fold(df, plan, "y", ["id"], "regression", {"a": "numeric", "b": "numeric"}, k=3)
    assert oof.count() == 90 and sorted(r[0] for r in oof.select("fold").distinct().collect()) == [0, 1, 2]
    avp = actual_vs_predicted(oof).first()
    assert avp["lo"] <= min(avp["label"], avp["prediction"]) and avp["hi"] >= max(avp["label"], avp["prediction"])
    # the relation is exactly linear: out-of-fold predictions recover it
    assert oof.agg(F.max(F.abs(F.col("label") - F.col("prediction")))).first()[0] < 1e-6


def test_summaries_and_chart(spark):
    rows = [(i, None if i % 4 == 0 else float(i), "k" if i % 2 else "m", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, x double, c string, t int")
    prof = profile(df, "t")
    cols = spark.createDataFrame(prof.columns)
    iss = detect_issues(df, "t", prof)
    ds = dataset_summary(cols, prof.to_frame(spark), iss).first()
    assert ds["n_rows"] == 40 and ds["n_cols"] == 4 and ds["max_missing_rate"] == 0.25
    chart = missingness_chart(cols).collect()
    assert [r["column"] for r in chart] == ["x"] and chart[0]["above_threshold"] is False
    run = spark.createDataFrame([("rule_based", "{}", 0.81234, 0.01, {"f1_macro": 0.812345}, 1, False)],
                                "method string, best_plan string, score double, cv_std double, "
                                "metric_values map<string,double>, n_iterations int, converged boolean")
    row = run_summary_row(dataset_summary(cols, prof.to_frame(spark), iss), run).first()
    assert row["score"] == 0.8123 and row["metric_values"]["f1_macro"] == 0.8123


def test_csv_export_and_preview(spark, scratch):
    df = _reg(spark, 30)
    write_csv(df, scratch + "/out.csv")
    back = load_table(spark, scratch + "/out.csv")
    assert back.count() == 30 and set(back.columns) == set(df.columns)
    first = [r["id"] for r in preview(df.repartition(4), ["id"]).collect()]
    assert first == list(range(10))
