import numpy as np
from pyspark.sql import functions as F

from quarry.operators.cluster import discover_clusters, pca_projection, summarize_clusters, ward_merge


def blobs(spark):
    rng = np.random.default_rng(42)
    rows = []
    for c, centre in enumerate((0.0, 5.0, 10.0)):
        for i in range(60):
            rows.append((c * 60 + i, float(centre + rng.normal(0, 0.3)), float(centre + rng.normal(0, 0.3)), "k"))
    return spark.createDataFrame(rows, "id int, x double, y double, cat string")


def test_three_blobs_each_method(spark):
    df = blobs(spark)
    for method in ("kmeans", "hierarchical", "dbscan"):
        res = discover_clusters(df, ["id"], ["x", "y"], method=method)
        assert res.n_clusters == 3, method
        assert res.silhouette > 0.5, method
    auto = discover_clusters(df, ["id"], ["x", "y"])
    assert auto.method in ("kmeans", "hierarchical", "dbscan") and auto.n_clusters == 3
    summ = summarize_clusters(df, auto.labels, ["id"], ["x", "y"]).collect()
    assert all(r["cluster"] >= 0 for r in summ)
    pts, ev, cents = pca_projection(df, auto.labels, ["id"], ["x", "y"])
    assert pts.count() == 180 and ev[0] > 0.9


def test_too_few_rows(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(10)], "id int, x double, y double")
    assert discover_clusters(df, ["id"], ["x", "y"]).labels is None


def test_ward_merge_groups():
    pts = np.array([[0.0], [0.1], [10.0], [10.2], [20.0]])
    g = ward_merge(pts, np.ones(5), 3)
    assert g[0] == g[1] and g[2] == g[3] and len(set(g)) == 3


def test_quality_of_many_clusters_by_blocks(spark, monkeypatch):
    """Above FEW_CLUSTERS the clusters stay a table; both indices equal the form with literals, singletons and noise included."""
    from pyspark.sql import functions as F

    from quarry.operators import cluster as C

    df = spark.range(400).select(((F.col("id") * 7) % 61 - 1).cast("int").alias("cluster"), *[(F.rand(i) + (F.col("id") * 7) % 61 * (i + 1)).alias(f"x{i}") for i in range(3)])
    df = df.union(spark.createDataFrame([(900, 1.0, 2.0, 3.0), (901, -4.0, 2.5, 0.0)], df.schema)).localCheckpoint()
    cols = ["x0", "x1", "x2"]
    vec = df.select("cluster", F.array(*cols).alias("features"))
    want = C.silhouette_sq(vec), C.davies_bouldin(df, cols)
    monkeypatch.setattr(C, "FEW_CLUSTERS", 5)
    got = C.silhouette_sq(vec), C.davies_bouldin(df, cols)
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))
