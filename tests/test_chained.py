import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import features as FE


def _gappy(spark, n=4000):
    i = F.col("id")
    base = spark.range(n).select("id", (F.randn(1) * 3 + 10).alias("a"), F.randn(2).alias("e"), F.randn(3).alias("f"))
    full = base.select("id", "a", (2 * F.col("a") - 5 + F.col("e")).alias("b"),
                       (1000 * F.col("e") + 200 * F.col("f")).alias("c"), (F.col("a") - F.col("f") * 0.5).alias("d"),
                       F.lit(7.0).alias("flat"), F.lit(None).cast("double").alias("void"))
    return full.select("id", "a", F.when(i % 4 != 1, F.col("b")).alias("b"), F.when(i % 5 != 2, F.col("c")).alias("c"),
                       F.when((i % 3 != 0) | (i % 7 == 0), F.col("d")).alias("d"), "flat", "void").cache()


COLS = ["a", "b", "c", "d", "flat", "void"]


def test_pattern_matrices_give_the_regressions_of_the_rows(spark):
    df = _gappy(spark)
    fast = FE.IterativeImpute(COLS).fit(df)
    slow = FE.IterativeImpute(COLS, pattern_cells=0).fit(df)
    assert fast.order == slow.order and set(fast.coefs) == {"b", "c", "d"}
    for c in fast.coefs:
        assert fast.coefs[c][2] == slow.coefs[c][2]
        assert fast.coefs[c][0] == pytest.approx(slow.coefs[c][0], rel=1e-3, abs=1e-3)
    a = fast.transform(df).orderBy("id").toPandas()
    b = slow.transform(df).orderBy("id").toPandas()
    for c in ("b", "c", "d"):
        assert np.abs(a[c] - b[c]).max() <= 1e-3 * b[c].std() and not a[c].isna().any()


def test_jobs_depend_neither_on_columns_nor_on_sweeps(spark):
    sc = spark.sparkContext

    def jobs(cols, sweeps):
        tag = f"chained-{len(cols)}-{sweeps}"
        sc.setJobGroup(tag, tag)
        FE.IterativeImpute(cols, max_sweeps=sweeps, tol=0.0).fit(df)
        n = len(sc.statusTracker().getJobIdsForGroup(tag))
        sc.setLocalProperty("spark.jobGroup.id", None)
        return n

    df = _gappy(spark, 500)
    df.count()
    assert jobs(["a", "b"], 2) == jobs(["a", "b", "c", "d"], 10)


def test_against_numpy_over_the_rows(spark):
    df = _gappy(spark, 800)
    cols = ["a", "b", "c", "d"]
    got = FE.IterativeImpute(cols, max_sweeps=3, tol=0.0).fit(df)
    x = df.orderBy("id").toPandas()[cols].to_numpy()
    gone = np.isnan(x)
    cur = np.where(gone, np.nanmean(x, axis=0), x)
    order = [cols.index(c) for c in got.order]
    for _ in range(3):
        for c in order:
            others = [o for o in range(4) if o != c]
            design = np.column_stack([np.ones(len(cur)), cur[:, others]])
            w = np.linalg.lstsq(design[~gone[:, c]], x[~gone[:, c], c], rcond=None)[0]
            cur[gone[:, c], c] = design[gone[:, c]] @ w
            last = w
        assert len(last) == 4
    for c, o in zip(got.order, order):
        others = [k for k in range(4) if k != o]
        design = np.column_stack([np.ones(len(cur)), cur[:, others]])
        weights, intercept, _ = got.coefs[c]
        mine = design @ np.concatenate([[intercept], weights])
        if c == got.order[-1]:  # the last regression of a sweep saw the final values of all the others
            assert np.abs(mine[gone[:, o]] - cur[gone[:, o], o]).max() < 1e-3 * np.nanstd(x[:, o])


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1.0, None)], [(1.0, 2.0), (None, 2.0), (3.0, None)]])
def test_tiny_and_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double")
    assert FE.IterativeImpute(["a", "b"]).fit(df).transform(df).count() == len(rows)
