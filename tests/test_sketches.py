import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import sketches as S
from quarry.functions.stats import column_quantiles
from quarry.operators.profile import profile_columns

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def _wide(spark, n=60_000):
    i = F.col("id")
    return spark.range(n).repartition(7).select(
        "id",
        F.when(i % 10 != 3, F.rand(5) * 1e9).alias("spread"),
        F.when(i % 2 == 0, 1.0).otherwise(2.0).alias("two"),
        (F.rand(7) * F.rand(8) * F.rand(9) * 40).cast("int").alias("skew"),
        F.when(i % 3 == 0, float("-inf")).when(i % 3 == 1, F.lit(float("nan"))).otherwise(F.randn(3)).alias("odd"),
        F.lit(None).cast("double").alias("none"),
        F.lit(4).alias("one"),
    )


def test_quantiles_of_raw_columns_are_exact(spark):
    df = _wide(spark)
    cols = ["spread", "two", "skew", "odd", "none", "one"]
    got = column_quantiles(df, cols, PROBS)
    pdf = df.toPandas()
    assert got["none"] is None
    for c in cols:
        x = np.sort(pdf[c].dropna().to_numpy(dtype=float))
        if c == "none":
            continue
        for p, v in zip(PROBS, got[c]):
            pos = p * (len(x) - 1)
            a, b = x[int(pos)], x[min(int(pos) + 1, len(x) - 1)]
            want = a if a == b else a + (pos - int(pos)) * (b - a)
            between = math.isnan(v) and math.isnan(want)  # halfway between -inf and a number
            assert between or v == want or math.isclose(v, want, rel_tol=1e-12), (c, p, v, want)


def test_a_proposal_that_misses_is_mended_by_the_counts(spark, monkeypatch):
    df = spark.range(30_000).select(((F.col("id") * 7919) % 30_011).cast("double").alias("x"))
    want = column_quantiles(df, ["x"], [0.2, 0.8])["x"]
    settle, wrong = S._settle, []

    def misled(o, got, found):
        if not wrong and "proposal" in got:  # the first proposals point far beside their ranks
            wrong.append(True)
            got["proposal"] = [(10.0, 12.0) if i % 2 else (29_000.0, 29_500.0) for i in range(len(got["proposal"]))]
        return settle(o, got, found)

    monkeypatch.setattr(S, "_settle", misled)
    assert column_quantiles(df, ["x"], [0.2, 0.8])["x"] == want and wrong
    assert want == pytest.approx(list(np.quantile(df.toPandas()["x"], [0.2, 0.8])))


def test_random_small_columns(spark):
    rnd = random.Random(4)
    for n in (1, 2, 5, 40):
        data = [(rnd.choice([None, -0.0, 0.0, 1.5, float(rnd.randrange(9))]),) for _ in range(n)] + [(2.0,)]
        got = column_quantiles(spark.createDataFrame(data, "x double"), ["x"], [0.25, 0.5])["x"]
        assert got == pytest.approx(list(pd.Series([d[0] for d in data], dtype=float).quantile([0.25, 0.5])))


def test_sketches_of_files_merge_to_the_sketch_of_the_table(spark):
    df = _wide(spark)
    parts = [S.column_sketches(df.where(F.col("id") % 3 == j)) for j in range(3)]
    merged = S.merge_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert merged.schema.simpleString() == S.column_sketches(df).schema.simpleString()
    pdf = df.toPandas()
    for r in S.sketch_estimates(merged, [0.25, 0.5, 0.75]).collect():
        x = pdf[r["column"]].dropna()
        assert (r["n_rows"], r["n_missing"]) == (len(pdf), len(pdf) - len(x))
        assert abs(r["n_unique"] - x.nunique()) <= max(1, 0.03 * x.nunique())
        if not len(x):
            assert r["quantiles"] is None
            continue
        for p, v in zip([0.25, 0.5, 0.75], r["quantiles"]):
            assert (x < v).mean() - 2 * S.KLL_ERROR <= p <= (x <= v).mean() + 2 * S.KLL_ERROR


def test_sketches_of_nothing(spark):
    empty = spark.createDataFrame([], "a int, t string, v array<int>")
    rows = {r["column"]: r for r in S.sketch_estimates(S.column_sketches(empty), [0.5]).collect()}
    assert {c: (r["n_rows"], r["n_unique"], r["quantiles"]) for c, r in rows.items()} == {
        "a": (0, 0, None), "t": (0, 0, None), "v": (0, None, None)}
    assert column_quantiles(empty, ["a"], [0.5]) == {"a": None}


def test_approximate_profile_counts_no_values(spark, monkeypatch):
    from quarry.operators import profile as P

    df = _wide(spark).withColumn("word", F.concat(F.lit("w"), F.least(F.col("skew"), F.lit(8)).cast("string")))
    exact = {r["column"]: r for r in profile_columns(df).collect()}
    monkeypatch.setattr(P, "value_counts_long", lambda *_: pytest.fail("count table built"))
    got = profile_columns(df, approx_quantiles=True)
    rows = {r["column"]: r for r in got.collect()}
    assert list(rows) == list(exact)
    for c, r in rows.items():
        e = exact[c]
        assert abs(r["n_unique"] - e["n_unique"]) <= max(1, 0.03 * e["n_unique"])
        for m in ("n_rows", "n_missing", "mean", "min", "max"):
            assert r[m] == e[m] or r[m] == pytest.approx(e[m]) or (r[m] != r[m] and e[m] != e[m])
    assert [tuple(t) for t in rows["word"]["top_categories"]] == [tuple(t) for t in exact["word"]["top_categories"]]
    assert abs(rows["spread"]["q1"] / exact["spread"]["q1"] - 1) < 0.02
    assert rows["two"]["sample_values"] == ["1.0", "2.0"]
