"""Centroid clustering of integer vectors with PCA-rotated filtering.

One pass gathers the mean and the cross products of all vectors; their leading
eigenvectors rotate the space.  Every vector is stored once with its leading
rotated coordinates y and the norm r of what the rotation leaves over.  For a
vector and a centroid, |y - y'|^2 + (r - r')^2 never exceeds their squared
distance.  A round takes the centroid of the least bound, gets its distance in
integers, and verifies in integers only those whose bound does not exceed it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.stage import read_table, staged
from quarry.llm.topk import quantised

#: Rotated coordinates that are stored; components beyond +-LIMIT would not leave squared distances in 64 bits.
LEAD, LIMIT = 16, 1 << 27
DIM, SCALE, CLUSTERS, ROUNDS = 64, 1024, 8, 10


def _rows(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _moments(dim: int):
    def run(batches):
        total, products = np.zeros(dim), np.zeros((dim, dim))
        n = 0
        for batch in batches:
            x = _rows(batch.column("v"), dim).astype(np.float64)
            total += x.sum(0)
            products += x.T @ x
            n += len(x)
        if n:
            values = np.concatenate([[n], total, products[np.triu_indices(dim)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["place", "value"])

    return run


def rotation(vectors: DataFrame, dim: int, lead: int = LEAD) -> tuple[np.ndarray, np.ndarray]:
    """(mean, dim x lead basis): the leading principal axes of all vectors.

    One row of dim^2 / 2 sums leaves each task; the driver gets their total.
    Any orthonormal basis gives right results, so rounding here costs speed only.
    """
    lead = min(lead, dim)
    sums = vectors.select("v").mapInArrow(_moments(dim), "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    values = {r.place: r.value for r in sums.collect()}
    if not values:
        return np.zeros(dim), np.eye(dim)[:, :lead]
    flat = np.array([values[i] for i in range(len(values))])
    n, mean = flat[0], flat[1 : dim + 1] / flat[0]
    cov = np.zeros((dim, dim))
    cov[np.triu_indices(dim)] = flat[dim + 1 :] / n
    cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
    _, axes = np.linalg.eigh(cov)
    return mean, np.ascontiguousarray(axes[:, ::-1][:, :lead])


def _rotated(x: np.ndarray, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and the norm of the rest."""
    d = x - mean
    y = d @ basis
    rest = d - y @ basis.T
    return y, np.sqrt((rest * rest).sum(1))


def _store(dim: int, mean: np.ndarray, basis: np.ndarray):
    def run(batches):
        for batch in batches:
            y, rest = _rotated(_rows(batch.column("v"), dim).astype(np.float64), mean, basis)
            at = pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32())
            columns = [*batch.columns, pa.ListArray.from_arrays(at, pa.array(y.ravel())), pa.array(rest)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lead", "rest"])

    return run


def nearest(x: np.ndarray, y: np.ndarray, rest: np.ndarray, centroids: np.ndarray, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, integer verifications) of each integer row of ``x``; ties to the smaller number."""
    cy, crest = _rotated(centroids.astype(np.float64), mean, basis)
    bound = ((y[:, None, :] - cy[None]) ** 2).sum(2) + (rest[:, None] - crest[None]) ** 2
    # rounding of coordinates and norms, relative to the magnitudes they are made of
    scale = np.sqrt((y * y).sum(1) + rest * rest)[:, None] + np.sqrt((cy * cy).sum(1) + crest * crest)[None] + np.abs(mean).sum() + 1
    bound -= 1e-10 * scale * scale
    first = bound.argmin(1)
    rows = np.arange(len(x))
    off = x - centroids[first]
    best = (off * off).sum(1)
    cluster, tested = first.copy(), len(x)
    for c in range(len(centroids)):
        open_ = rows[(bound[:, c] <= best) & (first != c)]
        if len(open_):
            off = x[open_] - centroids[c]
            d = (off * off).sum(1)
            better = (d < best[open_]) | ((d == best[open_]) & (c < cluster[open_]))
            best[open_[better]], cluster[open_[better]] = d[better], c
            tested += len(open_)
    return cluster, best, tested


def _assign(dim: int, centroids: np.ndarray, mean: np.ndarray, basis: np.ndarray):
    def each(batch):
        x = _rows(batch.column("v"), dim).astype(np.int64)
        y = _rows(batch.column("lead"), basis.shape[1])
        return x, *nearest(x, y, batch.column("rest").to_numpy(), centroids, mean, basis)[:2]

    def sums(batches):
        total, counts = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            x, cluster, _ = each(batch)
            for c in np.unique(cluster):
                total[c] += x[cluster == c].sum(0).astype(object)
                counts[c] += (cluster == c).sum()
        filled = np.flatnonzero(counts)
        cells = [(c, p, int(counts[c]), str(total[c, p])) for c in filled for p in range(dim)]
        if cells:
            c, p, n, t = zip(*cells, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(p, pa.int32()), pa.array(n, pa.int64()), pa.array(t)], names=["cluster", "place", "n", "total"])

    def rows(batches):
        for batch in batches:
            _, cluster, distance = each(batch)
            columns = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("v", "lead", "rest")]
            names = [n for n in batch.schema.names if n not in ("v", "lead", "rest")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=[*names, "cluster", "distance"])

    return sums, rows


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least sha256 of ``seed:vec_id``; a null id comes last, equal ids go by their components."""
    draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string")).cast("binary"), 256)
    draw = F.when(F.col("vec_id").isNotNull(), draw)
    got = vectors.select(draw.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in got], np.int64)


def cluster(vectors: DataFrame, dim: int, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3, lead: int = LEAD) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each vector and the final centroids.

    ``vectors`` has vec_id and v (array of long).  Rows with a null v or with
    other than ``dim`` components take no part.  A component beyond +-2^27
    raises.  Each round moves every non-empty centroid to the componentwise
    floor of its vectors' mean; empty ones stay; ties go to the smaller number.
    Rows that repeat an id, or a whole row, count each.  With fewer than k
    vectors there are fewer centroids; an empty table gives an empty result.
    Rounds after a fixed point are not run, as they change nothing.
    """
    wide = F.exists("v", lambda x: F.abs(x) > LIMIT)
    checked = F.when(wide, F.raise_error(F.lit("a component is too large for exact 64-bit distances"))).otherwise(F.col("v").cast("array<int>"))
    rows = vectors.where(F.size("v") == dim).select("vec_id", checked.alias("v"))
    rows = staged(rows, "centroids-vectors")
    centroids = first_centroids(rows, k, seed)
    kind = rows.schema["vec_id"].dataType
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dim), np.int64)
    mean, basis = rotation(rows, dim, lead)
    schema = T.StructType([*rows.schema.fields, T.StructField("lead", T.ArrayType(T.DoubleType())), T.StructField("rest", T.DoubleType())])
    store = staged(rows.mapInArrow(_store(dim, mean, basis), schema), "centroids-rotated")
    for _ in range(rounds):
        sums, _ = _assign(dim, centroids, mean, basis)
        parts = store.select("v", "lead", "rest").mapInArrow(sums, "cluster int, place int, n long, total string")
        cells = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        moved = centroids.copy()
        for r in cells:  # k * dim cells
            moved[r.cluster, r.place] = int(r.total) // r.n
        if (moved == centroids).all():
            break
        centroids = moved
    _, assign = _assign(dim, centroids, mean, basis)
    out = T.StructType([T.StructField("vec_id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return store.mapInArrow(assign, out), centroids


def query(spark, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding"), SCALE).alias("v"))
    assigned, centroids = cluster(vectors, DIM)
    assigned = staged(assigned, "centroids-assigned")
    inertia = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    whole = sum(inertia.values())
    facts = [(c, inertia.get(c, 0), whole, ",".join(map(str, centroids[c].tolist()))) for c in range(len(centroids))]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, components string")
    facts = facts.select("cluster", "cluster_inertia", "inertia", F.sha2(F.col("components").cast("binary"), 256).alias("centroid_sha256"))
    # one row per centroid: at most CLUSTERS
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The same rounds in SQL: one pair of common table expressions per round."""
    parts = [
        f"""raw AS (
    SELECT row_number() OVER () AS rid, vec_id, [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
    FROM embeddings WHERE embedding IS NOT NULL
), vecs AS MATERIALIZED (
    SELECT rid, vec_id, [CAST(x AS BIGINT) FOR x IN v] AS v FROM raw
    WHERE len(v) = {DIM} AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0
), m0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), v) - 1 AS c, v AS m
    FROM vecs QUALIFY c < {CLUSTERS}
)"""
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
    SELECT rid, vec_id, v, c, d FROM (
        SELECT rid, vec_id, v, c, list_sum([(v[i] - m[i]) * (v[i] - m[i]) FOR i IN range(1, {DIM + 1})]) AS d
        FROM vecs CROSS JOIN m{i}
    ) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1
)""")
        if i < ROUNDS:
            parts.append(f"""s{i} AS (
    SELECT c, p, sum(x) AS s, count(*) AS n
    FROM (SELECT c, unnest(v) AS x, unnest(range(1, {DIM + 1})) AS p FROM a{i}) GROUP BY c, p
), n{i} AS (
    SELECT c, list((s - (((s % n) + n) % n)) // n ORDER BY p) AS m FROM s{i} GROUP BY c
), m{i + 1} AS MATERIALIZED (
    SELECT m{i}.c, coalesce([CAST(x AS BIGINT) FOR x IN n{i}.m], m{i}.m) AS m FROM m{i} LEFT JOIN n{i} ON n{i}.c = m{i}.c
)""")
    last = ROUNDS
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, CAST(a{last}.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY a{last}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{last} JOIN m{last} ON m{last}.c = a{last}.c
"""


ORACLE = _oracle()
