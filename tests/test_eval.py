import itertools

from pyspark.sql import functions as F

from quarry.operators.folds import assign_kfold, assign_stratified, split
from quarry.operators.metrics import (
    auc,
    binary_metrics,
    composite_score,
    multiclass_metrics,
    regression_metrics,
    roc_points,
)


def test_stratified_exact_balance(spark):
    rows = [(i, "a" if i % 10 < 7 else "b") for i in range(203)]
    df = spark.createDataFrame(rows, "id int, y string")
    f = assign_stratified(df, ["id"], "y", 5)
    for cls in ("a", "b"):
        sizes = [r["count"] for r in f.where(F.col("y") == cls).groupBy("fold").count().collect()]
        assert max(sizes) - min(sizes) <= 1 and len(sizes) == 5


def test_split_and_kfold_are_deterministic(spark):
    df = spark.createDataFrame([(i,) for i in range(1000)], "id int")
    tr, te = split(df, ["id"])
    assert tr.count() + te.count() == 1000 and 120 < te.count() < 280
    a = {r["id"]: r["fold"] for r in assign_kfold(df.repartition(7), ["id"], 5).collect()}
    b = {r["id"]: r["fold"] for r in assign_kfold(df.repartition(3), ["id"], 5).collect()}
    assert a == b


def brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_with_ties_matches_brute_force(spark):
    pairs = [((i * 37 % 11) / 10.0, 1 if (i * 13) % 7 < 3 else 0) for i in range(120)]
    df = spark.createDataFrame([(0, s, y) for s, y in pairs], "fold int, score double, label int")
    got = auc(df, ["fold"], "score", F.col("label") == 1).first()["auc"]
    assert abs(got - brute_auc(pairs)) < 1e-12
    pts = roc_points(df, ["fold"], "score", F.col("label") == 1).orderBy(F.desc("score")).collect()
    assert pts[-1]["fpr"] == 1.0 and pts[-1]["tpr"] == 1.0


def test_single_class_fold_auc_is_null(spark):
    df = spark.createDataFrame([(0, 0.3, 1), (0, 0.6, 1)], "fold int, score double, label int")
    assert auc(df, ["fold"], "score", F.col("label") == 1).first()["auc"] is None


def test_binary_metrics_known_values(spark):
    rows = [(0, 1, 1, 0.9), (0, 1, 0, 0.4), (0, 0, 0, 0.2), (0, 0, 1, 0.6), (0, 0, 0, 0.1)]
    df = spark.createDataFrame(rows, "fold int, label int, prediction int, score double")
    m = binary_metrics(df, ["fold"]).first()
    assert abs(m["accuracy"] - 0.6) < 1e-12
    assert abs(m["sensitivity"] - 0.5) < 1e-12 and abs(m["specificity"] - 2 / 3) < 1e-12
    # f1 per class: pos 2*1/(2+1+1)=.5, neg 2*2/(4+1+1)=2/3
    assert abs(m["f1_macro"] - (0.5 + 2 / 3) / 2) < 1e-12
    assert abs(m["auc"] - 5 / 6) < 1e-12


def test_class_never_predicted_gives_zero_not_error(spark):
    rows = [(0, "a", "a"), (0, "b", "a"), (0, "c", "a")]
    df = spark.createDataFrame(rows, "fold int, label string, prediction string")
    m = multiclass_metrics(df, ["fold"], ["a", "b", "c"], probs=None).first()
    assert abs(m["precision_macro"] - (1 / 3) / 3) < 1e-12
    assert m["mcc"] == 0.0


def test_regression_metrics_and_mape_skips_zero_targets(spark):
    rows = [(0, 0.0, 1.0), (0, 2.0, 1.0), (0, 4.0, 5.0)]
    df = spark.createDataFrame(rows, "fold int, label double, prediction double")
    m = regression_metrics(df, ["fold"]).first()
    assert abs(m["mape"] - 100 * (0.5 + 0.25) / 2) < 1e-12
    assert abs(m["mae"] - 1.0) < 1e-12 and m["median_ae"] == 1.0


def test_composite_score(spark):
    df = spark.createDataFrame([(0.8, 0.1, 2)], "p double, s double, k int")
    assert abs(df.select(composite_score(F.col("p"), F.col("s"), F.col("k"))).first()[0] - (0.8 - 0.05 - 0.02)) < 1e-12
