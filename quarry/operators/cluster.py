"""Cluster discovery and description (C-1 .. C-9).

* Input rows: numeric complete cases (P-3) of the non-constant columns (P-4),
  standardised with the population std (C-1).  Row identity = key columns.
* k-means (C-2): ``ml.KMeans`` per k on one cached vector frame.
* Ward (C-3), two-phase at every size: ``KMeans`` to ``micro_clusters`` weighted
  micro-clusters on Spark (an argument), then the Ward merge of those centroids (a bounded
  table, never the rows) on the driver, and the labels are joined back.
* DBSCAN (C-4): micro-cells, see ``density.py``.
* Quality (C-5, C-6): the squared-Euclidean silhouette in linear time from
  per-cluster sufficient statistics (the exact Euclidean form needs all pairs
  and is not offered), and the Davies-Bouldin index from centroids.
* Summary (C-8) and 2-D PCA chart data (C-9).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.density import dbscan, dbscan_sweep  # noqa: F401 - dbscan is offered here
from quarry.operators.prep import nonconstant_columns
from quarry.session import checkpoint

# Fixed values of the cluster sweep.
MAX_K = 8
MIN_ROWS_PER_K = 5
MIN_ROWS = 20
DBSCAN_EPS = [0.3, 0.5, 0.7, 1.0, 1.5, 2.0]
DBSCAN_MIN_SAMPLES = 5
DBSCAN_MIN_POINTS = 10
MICRO_CLUSTERS = 256
SEED = 42
#: Up to so many clusters stand as literals in the plan of the silhouette.
FEW_CLUSTERS = 64
METHOD_ORDER = ["kmeans", "hierarchical", "dbscan"]


@dataclass
class Clustering:
    labels: DataFrame | None  # (key..., cluster)
    method: str | None
    n_clusters: int
    silhouette: float | None
    davies_bouldin: float | None
    features: list
    candidates: list  # (method, param, silhouette) tried

    def quality(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(self.method, self.n_clusters, self.silhouette, self.davies_bouldin)],
            "method string, n_clusters int, silhouette double, davies_bouldin double",
        )


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """C-1: (x - mean) / population std, one aggregation for all columns."""
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    out = df
    for i, c in enumerate(cols):
        s = row[f"s_{i}"] or 1.0
        out = out.withColumn(c, (F.col(c) - F.lit(row[f"m_{i}"])) / F.lit(s if s > 0 else 1.0))
    return out


def silhouette_sq(df: DataFrame, features: str = "features", label: str = "cluster") -> float | None:
    """C-5 (scalable form): mean squared-Euclidean silhouette, linear time.

    Per cluster: n, sum of vectors, sum of squared norms (a small table,
    broadcast).  For a row in cluster A: a = mean squared distance to the other
    members of A, b = min over other clusters of the mean squared distance;
    s = (b - a) / max(a, b), and 0 for singleton clusters.
    """
    x = vector_to_array(features) if dict(df.dtypes)[features] != "array<double>" else F.col(features)
    base = df.select(F.col(label).alias("c"), x.alias("x")).withColumn(
        "nx", F.aggregate(F.transform("x", lambda v: v * v), F.lit(0.0), lambda a, b: a + b)
    )
    dim = len(base.select("x").first()["x"])
    stats = base.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col("x")[i]) for i in range(dim)]).alias("y"),
        F.sum("nx").alias("psi"),
    )
    few = stats.limit(FEW_CLUSTERS + 1).collect()
    if len(few) < 2:
        return None
    if len(few) > FEW_CLUSTERS:
        return _silhouette_by_blocks(base, stats)
    stats = few
    # cluster table as literals: bounded by the cluster count
    parts = []
    for r in stats:
        y = F.array(*[F.lit(float(v)) for v in r["y"]])
        dot = F.aggregate(F.zip_with("x", y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        total = F.col("nx") * F.lit(float(r["n"])) + F.lit(float(r["psi"])) - 2 * dot
        parts.append(F.struct(F.lit(r["c"]).alias("c"), F.lit(int(r["n"])).alias("n"), total.alias("tot")))
    rows = base.withColumn("d", F.array(*parts))
    own = F.filter("d", lambda e: e["c"] == F.col("c"))[0]
    others = F.filter("d", lambda e: e["c"] != F.col("c"))
    a = F.when(own["n"] > 1, own["tot"] / (own["n"] - 1))
    b = F.array_min(F.transform(others, lambda e: e["tot"] / e["n"]))
    s = F.when(own["n"] <= 1, F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    return rows.agg(F.avg(s)).first()[0]


def _silhouette_step():
    """A function on a block of rows and one of clusters, made here so that it travels to the workers by value."""
    import numpy as np
    import pyarrow as pa

    def vectors(column):
        flat = column.combine_chunks().flatten().to_numpy()
        return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))

    def step(table):
        """(rid, mean squared distance to the rest of its cluster, least one to another cluster) as far as the block has them."""
        side = table.column("side").to_numpy()
        rows, clusters = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        if not rows.num_rows or not clusters.num_rows:
            return pa.table({"rid": pa.array([], pa.int64()), "a": pa.array([], pa.float64()), "b": pa.array([], pa.float64())})
        names = clusters.column("c").to_numpy()
        order = np.argsort(names)
        names, y = names[order], vectors(clusters.column("x"))[order]
        n, psi = clusters.column("rid").to_numpy()[order].astype(float), clusters.column("s").to_numpy()[order]
        x, c, nx = vectors(rows.column("x")), rows.column("c").to_numpy(), rows.column("s").to_numpy()
        a, b = np.full(len(x), np.nan), np.full(len(x), np.inf)
        for lo in range(0, len(x), 1024):
            hi, every = min(lo + 1024, len(x)), np.arange(min(1024, len(x) - lo))
            at = np.minimum(np.searchsorted(names, c[lo:hi]), len(names) - 1)
            own = names[at] == c[lo:hi]
            total = nx[lo:hi, None] * n + psi - 2 * (x[lo:hi] @ y.T)
            many = own & (n[at] > 1)
            a[lo:hi][many] = total[every[many], at[many]] / (n[at[many]] - 1)
            total /= n
            total[every[own], at[own]] = np.inf
            b[lo:hi] = total.min(1)
        return pa.table({"rid": rows.column("rid"), "a": pa.array(a, mask=np.isnan(a)), "b": b})

    return step


def _silhouette_by_blocks(base: DataFrame, stats: DataFrame) -> float | None:
    """The mean silhouette where clusters are many: blocks of rows meet blocks of clusters as matrix products."""
    base = checkpoint(base.withColumn("rid", F.monotonically_increasing_id()))
    stats = checkpoint(stats)
    n, k = base.count(), stats.count()
    rows_in, clusters_in = -(-n // min(max(n // 16, 1024), 16_384)), -(-k // 8192)
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    span = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = base.select(F.lit(0).alias("side"), F.col("c").cast("long").alias("c"), "rid", F.col("nx").alias("s"), "x", deal("rid", rows_in).alias("i"), span(clusters_in).alias("j"))
    clusters = stats.select(F.lit(1).alias("side"), F.col("c").cast("long").alias("c"), F.col("n").alias("rid"), F.col("psi").alias("s"), F.col("y").alias("x"), span(rows_in).alias("i"), deal("c", clusters_in).alias("j"))
    met = rows.union(clusters).repartition(min(1000, rows_in * clusters_in), "i", "j")
    near = met.groupBy("i", "j").applyInArrow(_silhouette_step(), "rid long, a double, b double")
    each = near.groupBy("rid").agg(F.max("a").alias("a"), F.min("b").alias("b"))
    s = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.agg(F.avg(s)).first()[0]


def davies_bouldin(df: DataFrame, cols: list[str], label: str = "cluster") -> float | None:
    """C-6: mean over clusters of max_j (s_i + s_j) / d(c_i, c_j); noise is a cluster here."""
    centres = df.groupBy(label).agg(*[F.avg(c).alias(c) for c in cols])
    cents = centres.limit(FEW_CLUSTERS + 1).collect()
    if len(cents) < 2:
        return None
    if len(cents) > FEW_CLUSTERS:
        return _davies_bouldin_by_blocks(df, centres, cols, label)
    cmap = {r[label]: np.array([r[c] for c in cols], dtype=float) for r in cents}
    expr = F.lit(None).cast("double")
    for k, v in cmap.items():
        d = F.sqrt(sum((F.col(c) - F.lit(float(v[i]))) ** 2 for i, c in enumerate(cols)))
        expr = F.when(F.col(label) == F.lit(k), d).otherwise(expr)
    scat = {r[label]: r["s"] for r in df.groupBy(label).agg(F.avg(expr).alias("s")).collect()}
    keys = list(cmap)
    vals = []
    for i in keys:
        worst = 0.0
        for j in keys:
            if i == j:
                continue
            dist = float(np.linalg.norm(cmap[i] - cmap[j]))
            r = (scat[i] + scat[j]) / dist if dist > 0 else float("inf")
            worst = max(worst, r)
        vals.append(worst)
    return float(np.mean(vals))


def _davies_bouldin_step():
    """A function on two blocks of clusters, made here so that it travels to the workers by value."""
    import numpy as np
    import pyarrow as pa

    def step(table):
        """(c, greatest (s_i + s_j) / d(c_i, c_j)) of the clusters of one block over those of the other."""
        side = table.column("side").to_numpy()
        left, right = (table.filter(pa.array(side == k)) for k in (0, 1))
        if not left.num_rows or not right.num_rows:
            return pa.table({"c": pa.array([], pa.int64()), "worst": pa.array([], pa.float64())})
        (c, s, x), (d, t, y) = ((k.column("c").to_numpy(), k.column("s").to_numpy(), k.column("x").combine_chunks().flatten().to_numpy().reshape(k.num_rows, -1)) for k in (left, right))
        worst = np.empty(len(c))
        for i in range(len(c)):
            gap = np.sqrt(((y - x[i]) ** 2).sum(1))
            r = np.divide(s[i] + t, gap, out=np.full(len(d), np.inf), where=gap > 0)
            worst[i] = np.where(d == c[i], 0.0, r).max()
        return pa.table({"c": c, "worst": worst})

    return step


def _davies_bouldin_by_blocks(df: DataFrame, centres: DataFrame, cols: list[str], label: str) -> float | None:
    """The index where clusters are many: centres stay a table, and blocks of them meet pairwise."""
    centres = checkpoint(centres.select(F.col(label).cast("long").alias("c"), F.array(*cols).alias("y")))
    rows = df.select(F.col(label).cast("long").alias("c"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    # the rows of a large cluster are dealt to several tasks
    deals = 16
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("x"), F.lit(deals)).cast("int"))
    spread = centres.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    gap = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    scatter = rows.join(spread, ["c", "deal"]).groupBy("c").agg(F.avg(gap).alias("s"))
    known = checkpoint(centres.join(scatter, "c").select("c", "s", F.col("y").alias("x")))
    n = known.count()
    blocks = -(-n // min(max(n // 16, 256), 8192))
    block, span = F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = known.select(F.lit(0).alias("side"), "c", "s", "x", block.alias("i"), span.alias("j"))
    right = known.select(F.lit(1).alias("side"), "c", "s", "x", span.alias("i"), block.alias("j"))
    met = left.union(right).repartition(min(1000, blocks * blocks), "i", "j")
    worst = met.groupBy("i", "j").applyInArrow(_davies_bouldin_step(), "c long, worst double")
    return worst.groupBy("c").agg(F.max("worst").alias("worst")).agg(F.avg("worst")).first()[0]


def _kmeans_labels(vec: DataFrame, k: int, seed: int):
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster", maxIter=50).fit(vec)
    return model, model.transform(vec)


def ward_merge(centroids: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Ward agglomeration of weighted points down to k groups; returns a group id per point.

    Merge cost of groups A, B: w_A w_B / (w_A + w_B) * |c_A - c_B|^2 (the Ward
    increase in within-group variance), kept in a dense matrix that is updated
    per merge (the input is the bounded micro-cluster table).
    """
    m = len(centroids)
    cent = centroids.astype(float).copy()
    w = weights.astype(float).copy()
    members = [[i] for i in range(m)]
    alive = np.ones(m, dtype=bool)

    def cost_row(a):
        d2 = np.sum((cent - cent[a]) ** 2, axis=1)
        c = w * w[a] / (w + w[a]) * d2
        c[~alive] = np.inf
        c[a] = np.inf
        return c

    D = np.vstack([cost_row(i) for i in range(m)]) if m else np.zeros((0, 0))
    for _ in range(m - k):
        flat = int(np.argmin(D))
        a, b = divmod(flat, m)
        if a > b:
            a, b = b, a
        cent[a] = (w[a] * cent[a] + w[b] * cent[b]) / (w[a] + w[b])
        w[a] += w[b]
        members[a] += members[b]
        alive[b] = False
        D[b, :] = np.inf
        D[:, b] = np.inf
        row = cost_row(a)
        D[a, :] = row
        D[:, a] = row
    out = np.zeros(m, dtype=int)
    roots = sorted((i for i in range(m) if alive[i]), key=lambda i: min(members[i]))
    for gid, a in enumerate(roots):
        for x in members[a]:
            out[x] = gid
    return out


def discover_clusters(df: DataFrame, key: list[str], features: list[str], method: str = "auto", max_k: int = MAX_K,
                      seed: int = SEED, micro_clusters: int = MICRO_CLUSTERS) -> Clustering:
    """C-7: pick the method (or the best by silhouette for "auto", ties in kmeans,
    hierarchical, dbscan order).  None when fewer than 20 complete rows or fewer
    than two usable columns.  A failing method is skipped and its error kept as
    (method, error text, None) among the candidates; when every method fails the
    last error is raised."""
    if method not in ("auto", *METHOD_ORDER):
        raise ValueError(f"Unknown clustering method: '{method}'")
    spark = df.sparkSession
    keyed = df.select(*key, *[F.when(F.abs(F.col(c).cast("double")) < F.lit(float("inf")), F.col(c).cast("double")).alias(c)
                              for c in features]).dropna("any")
    n = keyed.count()
    cols = nonconstant_columns(keyed, features)
    empty = Clustering(None, None, 0, None, None, cols, [])
    if n < MIN_ROWS or len(cols) < 2:
        return empty
    std = standardise(keyed.select(*key, *cols), cols)
    vec = VectorAssembler(inputCols=cols, outputCol="features").transform(std).persist(StorageLevel.MEMORY_AND_DISK)
    ks = list(range(2, min(max_k, n // MIN_ROWS_PER_K) + 1))
    tried, best, failed = [], None, []
    methods = METHOD_ORDER if method == "auto" else [method]
    for m in methods:
        try:
            if m == "kmeans":
                for k in ks:
                    _, lab = _kmeans_labels(vec, k, seed)
                    s = silhouette_sq(lab)
                    tried.append(("kmeans", k, s))
                    if s is not None and (best is None or s > best[2]):
                        best = ("kmeans", k, s, lab.select(*key, "cluster"))
            elif m == "hierarchical":
                micro_k = min(micro_clusters, n)
                mm, lab = _kmeans_labels(vec, micro_k, seed)
                sizes = {r["cluster"]: r["count"] for r in lab.groupBy("cluster").count().collect()}
                centers = mm.clusterCenters()
                ids = sorted(sizes)
                C = np.array([centers[i] for i in ids])
                W = np.array([sizes[i] for i in ids], dtype=float)
                for k in ks:
                    if k > len(ids):
                        break
                    grp = ward_merge(C, W, k)
                    mapping = spark.createDataFrame([(int(i), int(g)) for i, g in zip(ids, grp)], "micro int, cluster int")
                    wl = lab.withColumnRenamed("cluster", "micro").join(F.broadcast(mapping), "micro")
                    s = silhouette_sq(wl)
                    tried.append(("hierarchical", k, s))
                    if s is not None and (best is None or s > best[2]):
                        best = ("hierarchical", k, s, wl.select(*key, "cluster"))
            elif m == "dbscan":
                for eps, lab in zip(DBSCAN_EPS, dbscan_sweep(vec, key, cols, list(DBSCAN_EPS), DBSCAN_MIN_SAMPLES), strict=True):
                    stats = lab.agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("k"),
                                    F.count_if(F.col("cluster") >= 0).alias("nn")).first()
                    if stats["k"] < 2 or stats["nn"] < DBSCAN_MIN_POINTS:
                        tried.append(("dbscan", eps, None))
                        continue
                    inl = vec.join(lab.where(F.col("cluster") >= 0), key)
                    s = silhouette_sq(inl)
                    tried.append(("dbscan", eps, s))
                    if s is not None and (best is None or s > best[2]):
                        best = ("dbscan", eps, s, lab)
        except Exception as e:  # noqa: BLE001 - a failing method is skipped, as specified
            failed.append(e)
            tried.append((m, f"{type(e).__name__}: {e}"[:2000], None))
    if len(failed) == len(methods):
        vec.unpersist()
        raise failed[-1]
    if best is None:
        vec.unpersist()
        return Clustering(None, None, 0, None, None, cols, tried)
    labels = checkpoint(best[3])
    k_found = labels.where(F.col("cluster") >= 0).select("cluster").distinct().count()
    db = davies_bouldin(std.join(labels, key), cols)
    vec.unpersist()
    return Clustering(labels, best[0], k_found, best[2], db, cols, tried)


def summarize_clusters(df: DataFrame, labels: DataFrame, key: list[str], features: list[str], top: int = 3) -> DataFrame:
    """C-8: per non-negative cluster, the ``top`` columns by |cluster mean - overall mean|
    on unscaled values, with direction high/low and the cluster size."""
    j = df.select(*key, *features).join(labels, key)
    ords = {c: i for i, c in enumerate(features)}
    long = j.select("cluster", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(ords[c]).alias("ord"), F.col(c).cast("double").alias("v")) for c in features
    ])).alias("kv")).select("cluster", "kv.*")
    overall = long.groupBy("feature").agg(F.avg("v").alias("overall"))
    per = long.where(F.col("cluster") >= 0).groupBy("cluster", "feature", "ord").agg(F.avg("v").alias("mean"))
    sizes = labels.where(F.col("cluster") >= 0).groupBy("cluster").agg(F.count(F.lit(1)).alias("n_obs"))
    d = per.join(F.broadcast(overall), "feature").withColumn("diff", F.col("mean") - F.col("overall"))
    w = Window.partitionBy("cluster").orderBy(F.desc(F.abs("diff")), "ord")
    ranked = d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.join(sizes, "cluster").select(
        "cluster", "n_obs", "rank", "feature",
        F.when(F.col("diff") > 0, "high").otherwise("low").alias("direction"),
        F.abs("diff").alias("abs_diff"),
    )


def pca_projection(df: DataFrame, labels: DataFrame, key: list[str], features: list[str]):
    """C-9: 2-D PCA of the clustered rows (mean-filled, centred, unscaled).

    Returns (points (key..., cluster, pc1, pc2), explained-variance ratio list,
    per-cluster centroid frame).  ``ml.PCA`` does not centre, so rows are
    centred first.
    """
    j = df.select(*key, *features).join(labels, key)
    means = j.agg(*[F.avg(c).alias(c) for c in features]).first()
    cen = j.select(*key, "cluster", *[(F.coalesce(F.col(c).cast("double"), F.lit(means[c])) - F.lit(means[c])).alias(c)
                                     for c in features])
    vec = VectorAssembler(inputCols=features, outputCol="v").transform(cen)
    model = PCA(k=2, inputCol="v", outputCol="pc").fit(vec)
    pts = model.transform(vec).select(*key, "cluster", vector_to_array("pc").alias("pc"))
    pts = pts.select(*key, "cluster", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))
    cents = pts.groupBy("cluster").agg(F.avg("pc1").alias("pc1"), F.avg("pc2").alias("pc2"))
    return pts, list(model.explainedVariance.toArray()), cents
