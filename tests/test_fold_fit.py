"""Statistics shared by all folds give the stages that each fold's own pipeline fits."""

import random

import pytest

from quarry.operators import features as FE
from quarry.operators.folds import CROSS_COLUMN, cross_folds
from quarry.operators.models import build_pipeline
from quarry.plans.evaluate import Training
from quarry.plans.fold_fit import FoldFits

TYPES = {"a": "numeric", "b": "numeric", "k": "numeric", "e": "numeric", "c": "categorical", "d": "categorical", "y": "numeric", "id": "numeric"}


@pytest.fixture(scope="module")
def frame(spark):
    r = random.Random(1)
    rows = []
    for i in range(240):
        a = None if r.random() < 0.1 else r.gauss(0, 1)
        b = float("inf") if r.random() < 0.02 else None if r.random() < 0.2 else float(r.randint(0, 5))
        c = None if r.random() < 0.1 else r.choice("pqrs")
        d = f"only{i}" if r.random() < 0.05 else r.choice(["u", "v"])
        rows.append((i, a, b, 7.0, None, c, d, int((a or 0) + (c == "p") + r.gauss(0, 0.5) > 0.5)))
    return spark.createDataFrame(rows, "id int, a double, b double, k double, e double, c string, d string, y int").cache()


def plan(**kw):
    return dict(plan_id="p", imputation="median", outlier_handling="none", encoding="onehot", scaling="none", model="logistic_regression", imbalance_strategy="none") | kw


@pytest.mark.parametrize("kw", [
    dict(outlier_handling="winsorize", scaling="robust"),
    dict(imputation="mean", scaling="standard", encoding="target"),
    dict(imputation="mean", outlier_handling="winsorize", scaling="minmax", encoding="ordinal"),
])
def test_same_features_as_a_pipeline_per_fold(spark, frame, kw):
    with Training(frame, "y", ["id"], "binary", TYPES, 2) as t:
        for i in (0, 2):  # a fold's training set and the whole frame
            train = t.folded.where(f"fold <> {i}")
            got = t.fits.preprocessing(plan(**kw), i)
            stages = build_pipeline(plan(**kw), t.feats, "binary").getStages()[:-1]
            model, cur = [], train
            for s in stages:
                m = s.fit(cur) if hasattr(s, "fit") else s
                cur = m.transform(cur)
                model.append(m)
            for rows in (train, t.folded.where("fold = 0").drop(CROSS_COLUMN)):
                want = rows
                for m in model:
                    want = m.transform(want)
                x, y = ({r.id: r.features.toArray() for r in f.select("id", "features").collect()} for f in (got.transform(rows), want))
                assert x.keys() == y.keys() and x
                assert max(abs(x[k] - y[k]).max() for k in x) < 1e-9


def test_statistics_are_counted_once(spark, frame):
    with Training(frame, "y", ["id"], "binary", TYPES, 3) as t:
        tracker = spark.sparkContext.statusTracker()
        group = lambda name, p, sets: (spark.sparkContext.setJobGroup(name, name), [t.fits.preprocessing(p, i) for i in sets], len(tracker.getJobIdsForGroup(name)))[2]
        first = group("first", plan(), [0])
        again = group("again", plan(encoding="ordinal"), [0, 1, 2, 3])
        assert first > 0 and again == 0
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_training_rows_never_see_their_label(spark):
    rows = [(i, "abc"[i % 3] if i % 7 else None, float(i % 5 == 0)) for i in range(60)]
    df = cross_folds(spark.createDataFrame(rows, "id int, c string, label double"), ["id"])
    base = {r.id: r.c__te0 for r in FE.TargetEncode(["c"]).fit(df).transform(df).collect()}
    fold = {r.id: r[CROSS_COLUMN] for r in df.collect()}
    turned = df.selectExpr("id", "c", "case when id = 10 then 1 - label else label end as label", CROSS_COLUMN)
    after = {r.id: r.c__te0 for r in FE.TargetEncode(["c"]).fit(turned).transform(turned).collect()}
    assert all(abs(base[i] - after[i]) < 1e-12 for i in base if fold[i] == fold[10])
    assert any(abs(base[i] - after[i]) > 1e-6 for i in base if fold[i] != fold[10])
    model = FE.TargetEncode(["c"]).fit(df)
    full = {r.c: r.c__te0 for r in model.transform(df.drop(CROSS_COLUMN)).collect()}
    y = [x for _, _, x in rows]
    own = [x for _, c, x in rows if c == "a"]
    assert abs(full["a"] - (sum(own) + 10 * sum(y) / 60) / (len(own) + 10)) < 1e-12
    lone = spark.createDataFrame([(1, "new", 0.0, 2)], f"id int, c string, label double, {CROSS_COLUMN} int")
    other = [x for i, _, x in rows if fold[i] != 2]
    assert abs(model.transform(lone).first().c__te0 - sum(other) / len(other)) < 1e-12


def test_plans_that_need_whole_rows(spark):
    assert not FoldFits.handles(plan(imputation="knn")) and FoldFits.handles(plan())
