"""Checks for cluster quality and description (C-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.checks.check_eval import LI_KEY
from quarry.operators.cluster import davies_bouldin, dbscan, discover_clusters, pca_projection, silhouette_sq, summarize_clusters
from quarry.registry import r6, register, table

DIM = 64

QUALITY_SQL = f"""
WITH e AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, {DIM + 1}) r(i)),
nx AS (SELECT vec_id, label, sum(v * v) AS nx FROM e GROUP BY vec_id, label),
cs AS (SELECT label AS c, count(*) AS n, sum(nx) AS psi FROM nx GROUP BY label),
cy AS (SELECT label AS c, i, sum(v) AS y, avg(v) AS m FROM e GROUP BY label, i),
dt AS (SELECT e.vec_id, cy.c, sum(e.v * cy.y) AS dot FROM e JOIN cy ON e.i = cy.i GROUP BY e.vec_id, cy.c),
tot AS (SELECT dt.vec_id, nx.label AS own, dt.c, cs.n, nx.nx * cs.n + cs.psi - 2 * dt.dot AS t
        FROM dt JOIN nx ON dt.vec_id = nx.vec_id JOIN cs ON dt.c = cs.c),
ab AS (SELECT vec_id, max(CASE WHEN c = own AND n > 1 THEN t / (n - 1) END) AS a,
              min(CASE WHEN c <> own THEN t / n END) AS b, max(CASE WHEN c = own THEN n END) AS nown
       FROM tot GROUP BY vec_id),
sil AS (SELECT avg(CASE WHEN nown <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab),
sc AS (SELECT e.label AS c, avg(d) AS s FROM (SELECT e.vec_id, e.label, sqrt(sum((e.v - cy.m) ** 2)) AS d
        FROM e JOIN cy ON e.label = cy.c AND e.i = cy.i GROUP BY e.vec_id, e.label) e GROUP BY e.label),
md AS (SELECT a.c AS ci, b.c AS cj, sqrt(sum((a.m - b.m) ** 2)) AS dist FROM cy a JOIN cy b ON a.i = b.i AND a.c <> b.c
       GROUP BY a.c, b.c),
db AS (SELECT avg(worst) AS davies_bouldin FROM (SELECT md.ci, max((si.s + sj.s) / md.dist) AS worst
        FROM md JOIN sc si ON md.ci = si.c JOIN sc sj ON md.cj = sj.c GROUP BY md.ci) w)
SELECT R6(silhouette) AS silhouette, R6(davies_bouldin) AS davies_bouldin FROM sil, db"""


@register("cluster_quality_embeddings", QUALITY_SQL)
def q_cluster_quality(spark, sf):
    """C-5 (squared-Euclidean silhouette) and C-6 (Davies-Bouldin) for the given labels."""
    e = table(spark, sf, "embeddings")
    vec = e.select(F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("features"))
    s = silhouette_sq(vec)
    wide = e.select(F.col("label").alias("cluster"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIM)])
    db = davies_bouldin(wide, [f"e{i}" for i in range(DIM)])
    raw = spark.createDataFrame([(s, db)], "s double, d double")
    return raw.select(r6(F.col("s")).alias("silhouette"), r6(F.col("d")).alias("davies_bouldin"))


SUMMARY_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _summary_sql():
    u = " UNION ALL ".join(
        f"SELECT l_linenumber - 1 AS cluster, '{c}' AS feature, {i} AS ord, CAST({c} AS DOUBLE) AS v FROM lineitem"
        for i, c in enumerate(SUMMARY_FEATS)
    )
    return f"""
WITH u AS ({u}),
o AS (SELECT feature, avg(v) AS overall FROM u GROUP BY feature),
p AS (SELECT cluster, feature, ord, avg(v) AS mean FROM u GROUP BY cluster, feature, ord),
n AS (SELECT l_linenumber - 1 AS cluster, count(*) AS n_obs FROM lineitem GROUP BY 1),
d AS (SELECT p.*, mean - overall AS diff FROM p JOIN o USING (feature)),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(diff) DESC, ord) AS rank FROM d)
SELECT CAST(r.cluster AS INTEGER) AS cluster, CAST(n.n_obs AS BIGINT) AS n_obs, CAST(rank AS INTEGER) AS rank, feature,
       CASE WHEN diff > 0 THEN 'high' ELSE 'low' END AS direction, R6(abs(diff)) AS abs_diff
FROM r JOIN n USING (cluster) WHERE rank <= 3"""


@register("cluster_summary_lineitem", _summary_sql())
def q_cluster_summary(spark, sf):
    """C-8: top-3 distinguishing columns per cluster (labels given: line number)."""
    li = table(spark, sf, "lineitem")
    labels = li.select(*LI_KEY, (F.col("l_linenumber") - 1).cast("int").alias("cluster"))
    s = summarize_clusters(li, labels, LI_KEY, SUMMARY_FEATS)
    return s.select("cluster", "n_obs", F.col("rank").cast("int").alias("rank"), "feature", "direction",
                    r6(F.col("abs_diff")).alias("abs_diff"))


@register("kmeans_clusters_customer")
def q_kmeans(spark, sf):
    """C-1, C-2, C-5, C-7: k-means sweep on customer balances and nations (labels per row)."""
    c = table(spark, sf, "customer")
    res = discover_clusters(c, ["c_custkey"], ["c_acctbal", "c_nationkey"], method="kmeans")
    return res.labels


@register("ward_clusters_customer")
def q_ward(spark, sf):
    """C-3: two-phase Ward clustering (labels per row)."""
    c = table(spark, sf, "customer")
    res = discover_clusters(c, ["c_custkey"], ["c_acctbal", "c_nationkey"], method="hierarchical")
    return res.labels


@register("dbscan_clusters_embeddings")
def q_dbscan(spark, sf):
    """C-4: DBSCAN eps sweep on the 64-d embeddings (labels per row, -1 = noise; may find no valid clustering)."""
    e = table(spark, sf, "embeddings")
    wide = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIM)])
    res = discover_clusters(wide, ["vec_id"], [f"e{i}" for i in range(DIM)], method="dbscan")
    if res.labels is None:
        return spark.createDataFrame([], "vec_id bigint, cluster int")
    return res.labels


LINE_EPS, LINE_MIN = 25, 5
LINE_X = "o_orderkey * 10 + CAST(round(o_totalprice * 100) AS BIGINT) % 97"

#: On one axis DBSCAN is a window problem: cores by a range count, a cluster ends where the next core is farther than eps.
LINE_SQL = f"""
WITH p AS (SELECT o_orderkey AS id, {LINE_X} AS x FROM orders),
n AS (SELECT *, count(*) OVER (ORDER BY x RANGE BETWEEN {LINE_EPS} PRECEDING AND {LINE_EPS} FOLLOWING) AS near FROM p),
b AS (SELECT id, x, CASE WHEN x - lag(x) OVER (ORDER BY x, id) <= {LINE_EPS} THEN 0 ELSE 1 END AS starts
      FROM n WHERE near >= {LINE_MIN}),
g AS (SELECT id, x, sum(starts) OVER (ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS grp FROM b),
core AS (SELECT id, x, min(id) OVER (PARTITION BY grp) AS lab FROM g),
border AS (SELECT n.id, min(core.lab) AS lab FROM n JOIN core ON core.x BETWEEN n.x - {LINE_EPS} AND n.x + {LINE_EPS}
           WHERE near < {LINE_MIN} GROUP BY n.id),
lab AS (SELECT id, lab FROM core UNION ALL SELECT id, lab FROM border),
num AS (SELECT lab, row_number() OVER (ORDER BY lab) - 1 AS cluster FROM (SELECT DISTINCT lab FROM lab))
SELECT p.id AS o_orderkey, CAST(coalesce(num.cluster, -1) AS INTEGER) AS cluster
FROM p LEFT JOIN lab ON p.id = lab.id LEFT JOIN num ON lab.lab = num.lab"""


@register("dbscan_labels_orders", LINE_SQL)
def q_dbscan_line(spark, sf):
    """C-4: DBSCAN labels of every order on one axis: chains, border rows and noise at a density that all sizes share."""
    pts = table(spark, sf, "orders").select("o_orderkey", F.expr(LINE_X).cast("double").alias("x"))
    return dbscan(pts, ["o_orderkey"], ["x"], float(LINE_EPS), LINE_MIN)


PLANE_EPS, PLANE_MIN = 17, 5
PLANE_X, PLANE_Y = "p_size * 10", "CAST(round(p_retailprice * 10) AS BIGINT) % 1000"

#: All pairs of the plane, then the smallest core row that each core row reaches.
PLANE_SQL = f"""
WITH RECURSIVE p AS (SELECT p_partkey AS id, CAST({PLANE_X} AS DOUBLE) AS x, CAST({PLANE_Y} AS DOUBLE) AS y FROM part),
e AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b
      ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {PLANE_EPS * PLANE_EPS}),
core AS (SELECT u AS id FROM e GROUP BY u HAVING count(*) >= {PLANE_MIN}),
cc AS (SELECT u, v FROM e JOIN core a ON a.id = u JOIN core b ON b.id = v WHERE u <> v),
reach AS (SELECT id, id AS lab FROM core UNION SELECT cc.v, r.lab FROM reach r JOIN cc ON cc.u = r.id WHERE r.lab < cc.v),
c AS (SELECT id, min(lab) AS lab FROM reach GROUP BY id),
border AS (SELECT e.u AS id, min(c.lab) AS lab FROM e JOIN c ON c.id = e.v WHERE e.u NOT IN (SELECT id FROM core) GROUP BY e.u),
lab AS (SELECT id, lab FROM c UNION ALL SELECT id, lab FROM border),
num AS (SELECT lab, row_number() OVER (ORDER BY lab) - 1 AS cluster FROM (SELECT DISTINCT lab FROM c))
SELECT p.id AS p_partkey, CAST(coalesce(num.cluster, -1) AS INTEGER) AS cluster
FROM p LEFT JOIN lab ON p.id = lab.id LEFT JOIN num ON lab.lab = num.lab"""


@register("dbscan_plane_part", PLANE_SQL)
def q_dbscan_plane(spark, sf):
    """C-4: DBSCAN labels of every part in the plane of size and price."""
    pts = table(spark, sf, "part").select("p_partkey", F.expr(PLANE_X).cast("double").alias("x"), F.expr(PLANE_Y).cast("double").alias("y"))
    return dbscan(pts, ["p_partkey"], ["x", "y"], float(PLANE_EPS), PLANE_MIN)


@register("pca_points_customer")
def q_pca(spark, sf):
    """C-9: 2-D PCA coordinates of the clustered rows."""
    c = table(spark, sf, "customer")
    labels = c.select("c_custkey", F.when(F.col("c_acctbal") >= 0, 1).otherwise(0).alias("cluster"))
    pts, _, _ = pca_projection(c, labels, ["c_custkey"], ["c_acctbal", "c_nationkey"])
    return pts
