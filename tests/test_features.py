import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quarry.operators import features as FE
from quarry.operators.models import build_pipeline


def test_winsorizer_clips_to_train_fence(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (1000.0,)], "x double")
    m = FE.Winsorizer(["x"]).fit(train)
    got = [r[0] for r in m.transform(train).collect()]
    assert got[-1] == 4.0 + 1.5 * 2.0 and got[:4] == [1.0, 2.0, 3.0, 4.0]
    keep = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (5.0,)], "x double")
    assert [r[0] for r in FE.Winsorizer(["x"]).fit(keep).transform(keep).collect()] == [1.0, 2.0, 3.0, 4.0, 5.0]
    test = spark.createDataFrame([(100.0,), (None,)], "x double")
    assert [r[0] for r in m.transform(test).collect()] == [7.0, None]


def test_median_interpolates_and_empty_dropped(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (10.0, None), (None, None)], "x double, e double")
    dropped = FE.DropEmpty(["x", "e"]).fit(df).transform(df)
    assert dropped.columns == ["x"]
    filled = FE.SimpleImpute(["x"], "median").fit(dropped).transform(dropped)
    assert [r[0] for r in filled.collect()][-1] == 2.5


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    mm = FE.Scaler(["x", "c"], "minmax").fit(df).transform(df).collect()
    assert [r["x"] for r in mm] == [0.0, 0.5, 1.0] and [r["c"] for r in mm] == [0.0, 0.0, 0.0]
    st = FE.Scaler(["x"], "standard").fit(df).transform(df).collect()
    assert abs(st[2]["x"] - 1.0 / (2 / 3) ** 0.5) < 1e-12
    rb = FE.Scaler(["x"], "robust").fit(df).transform(df).collect()
    assert [r["x"] for r in rb] == [-1.0, 0.0, 1.0]


def test_onehot_unseen_is_all_zero_and_ordinal_minus_one(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "city string")
    test = spark.createDataFrame([("b",), ("zzz",)], "city string")
    oh = FE.OneHotEncode(["city"]).fit(train)
    rows = oh.transform(test).select(vector_to_array("city__enc").alias("v")).collect()
    assert rows[0]["v"] == [0.0, 1.0, 0.0] and rows[1]["v"] == [0.0, 0.0, 0.0]
    od = FE.OrdinalEncode(["city"]).fit(train)
    assert [r[0] for r in od.transform(test).select("city__enc").collect()] == [1.0, -1.0]


def test_most_frequent_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    out = FE.MostFrequentImpute(["c"]).fit(df).transform(df)
    assert [r[0] for r in out.collect()] == ["b", "a", "a"]


def test_class_weights_and_factorize(spark):
    df = spark.createDataFrame([(0.0,)] * 3 + [(1.0,)], "label double")
    w = {r["label"]: r["weight"] for r in FE.class_weight_column(df).distinct().collect()}
    assert w == {0.0: 4 / (2 * 3), 1.0: 4 / (2 * 1)}
    f = FE.factorize(spark.createDataFrame([("b",), ("a",), (None,)], "s string"), ["s"])
    assert sorted(r[0] for r in f.collect()) == [-1.0, 0.0, 1.0]


def test_bad_names_raise(spark):
    base = dict(plan_id="p", imputation="median", outlier_handling="none", encoding="onehot",
                scaling="standard", model="logistic_regression", imbalance_strategy="none")
    for field, bad in (("imputation", "magic"), ("scaling", "zscore"), ("encoding", "hash"), ("model", "svm")):
        with pytest.raises(ValueError):
            build_pipeline({**base, field: bad}, {"x": "numeric"}, "binary")
    with pytest.raises(ValueError):
        build_pipeline(base, {"d": "datetime"}, "binary")


def test_iterative_imputer_recovers_linear_relation(spark):
    rows = [(float(i), 2.0 * i + 1.0 if i % 5 else None) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "x double, y double")
    out = FE.IterativeImpute(["x", "y"]).fit(df).transform(df).where(F.col("x") == 5.0).first()
    assert abs(out["y"] - 11.0) < 1e-3


def test_knn_imputer_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    X = rng.normal(size=(60, 3)).round(3)
    X[rng.random((60, 3)) < 0.15] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in X]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    from quarry.operators.neighbors import KnnImpute

    out = KnnImpute(["a", "b", "c"]).fit(df).transform(df).collect()

    def dist(x, y):
        m = ~np.isnan(x) & ~np.isnan(y)
        return np.sqrt(3 / m.sum() * np.sum((x[m] - y[m]) ** 2)) if m.sum() else np.nan

    got = {tuple(np.nan if v is None else v for v in r): None for r in rows}
    expect = []
    for i, x in enumerate(X):
        y = x.copy()
        for j in np.where(np.isnan(x))[0]:
            cand = [(dist(x, X[d]), d) for d in range(60) if d != i and not np.isnan(X[d, j])]
            cand = sorted([c for c in cand if not np.isnan(c[0])])[:5]
            y[j] = np.mean([X[d, j] for _, d in cand])
        expect.append(y)
    exp_sorted = sorted(tuple(round(v, 9) for v in r) for r in expect)
    got_sorted = sorted(tuple(round(v, 9) for v in (r["a"], r["b"], r["c"])) for r in out)
    assert exp_sorted == got_sorted


def test_smote_balances_classes(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense([float(i), float(i % 7)]), 0.0) for i in range(40)] + \
           [(Vectors.dense([100.0 + i, float(i % 3)]), 1.0) for i in range(8)]
    df = spark.createDataFrame(rows, ["features", "label"])
    from quarry.operators.neighbors import smote

    out = smote(df)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0.0: 40, 1.0: 40}
    xs = [r["features"][0] for r in out.where("label = 1.0").collect()]
    assert min(xs) >= 100.0 and max(xs) <= 107.0  # synthetic rows lie between class members


def test_knn_grid_path_with_hot_anchor_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    n = 80
    a = np.where(rng.random(n) < 0.5, 1.0, rng.normal(size=n).round(3))  # hot value on half the rows
    b = rng.normal(scale=50, size=n).round(2)  # a second anchor on a very different scale
    c = rng.normal(size=n).round(3)
    c[rng.random(n) < 0.3] = np.nan
    X = np.column_stack([a, b, c])
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in X],
                               "a double, b double, c double")
    from quarry.operators.neighbors import KnnImpute

    out = KnnImpute(["a", "b", "c"]).fit(df).transform(df).collect()
    expect = []
    for i, x in enumerate(X):
        y = x.copy()
        if np.isnan(x[2]):
            cand = sorted((np.sqrt(3 / 2 * ((x[0] - X[d, 0]) ** 2 + (x[1] - X[d, 1]) ** 2)), d)
                          for d in range(n) if not np.isnan(X[d, 2]))[:5]
            y[2] = np.mean([X[d, 2] for _, d in cand])
        expect.append(tuple(round(v, 9) for v in y))
    got = sorted(tuple(round(v, 9) for v in (r["a"], r["b"], r["c"])) for r in out)
    assert got == sorted(expect)
