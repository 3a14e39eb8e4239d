"""Cases that round 1 got wrong."""

import math

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quarry.functions.stats import column_quantiles
from quarry.operators.cluster import dbscan
from quarry.operators.neighbors import smote
from quarry.operators.profile import duplicate_count
from quarry.sources.readers import load_table


def test_dbscan_joins_a_long_chain(spark):
    pts = spark.range(120).select("id", (F.col("id") * 0.2).alias("x"), F.lit(0.0).alias("y"))
    far = spark.createDataFrame([(500, 1000.0, 1000.0)], "id long, x double, y double")
    labels = {r["id"]: r["cluster"] for r in dbscan(pts.unionByName(far), ["id"], ["x", "y"], 0.5, 3).collect()}
    assert {labels[i] for i in range(120)} == {0} and labels[500] == -1


def test_quartiles_with_infinities_and_wide_ranges(spark):
    n = 2000
    df = spark.range(n).select(F.when(F.col("id") == n - 1, float("inf")).otherwise(F.col("id").cast("double")).alias("a"),
                               F.pow(F.lit(10.0), F.col("id") % 601 - 300).alias("b"))
    got = column_quantiles(df, ["a", "b"], [0.25, 0.75, 1.0])
    assert got["a"][:2] == [0.25 * (n - 1), 0.75 * (n - 1)] and got["a"][2] == math.inf
    rows = sorted(r["b"] for r in df.select("b").collect())
    assert got["b"][2] == rows[-1] and rows[499] <= got["b"][0] <= rows[500]


def test_smote_counts_repeated_minority_rows(spark):
    rows = [(1.0, Vectors.dense([float(i % 4), 1.0])) for i in range(12)] + [(0.0, Vectors.dense([float(i), 5.0])) for i in range(40)]
    df = spark.createDataFrame(rows, ["label", "features"])
    assert {r["label"]: r["count"] for r in smote(df).groupBy("label").count().collect()} == {0.0: 40, 1.0: 40}
    same = spark.createDataFrame([(1.0, Vectors.dense([2.0, 1.0]))] * 12 + rows[12:], ["label", "features"])
    out = smote(same)
    assert out.where("label = 1").count() == 40 and out.where("label = 1").select("features").distinct().count() == 1


def test_nan_equals_null_in_duplicates(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, None), (2, 1.0)], "a int, b double")
    assert duplicate_count(df).first()["n_duplicates"] == 1


def test_csv_dates_stay_strings(spark, scratch):
    with open(f"{scratch}/t.csv", "w") as f:
        f.write("d,t,n\n2024-01-02,2024-01-02 03:04:05,7\n")
    df = load_table(spark, f"{scratch}/t.csv")
    assert [t for _, t in df.dtypes] == ["string", "string", "int"] and df.first()["d"] == "2024-01-02"
