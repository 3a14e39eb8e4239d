"""Centroid rounds against plain integer arithmetic."""

import hashlib

import numpy as np
import pytest

from quarry.llm import centroids


def plain(rows, dim, k=8, rounds=10, seed=3):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dim]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    at = [list(v) for _, v in order[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(at)) for _, v in kept]

    for _ in range(rounds):
        own = [j for _, j in assign()]
        for j in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i is None, i or 0), j, d) for (i, _), (d, j) in zip(kept, assign(), strict=True)), at


def rows_of(seed, n, dim, spread):
    r = np.random.default_rng(seed)
    hubs = r.integers(-spread, spread + 1, (5, dim))
    v = hubs[r.integers(0, 5, n)] + r.integers(-spread // 3 - 1, spread // 3 + 2, (n, dim))
    return [(i, [int(x) for x in row]) for i, row in enumerate(v)]


@pytest.mark.parametrize(("n", "dim", "spread", "lead"), [(150, 6, 3, 2), (60, 5, 1 << 25, 5), (90, 4, 1, 1), (5, 3, 9, 3)])
def test_clusters_against_plain_rounds(spark, n, dim, spread, lead):
    rows = rows_of(n, n, dim, spread)
    rows += [rows[0], rows[0], (1, rows[3][1]), (None, rows[2][1]), (900, None), (901, [1]), (902, [0] * dim), (903, [0] * dim)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, v array<long>, cluster string").repartition(3)
    got, at = centroids.cluster(df, dim, lead=lead)
    want, want_at = plain(rows, dim)
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance) for r in got.collect()) == want
    assert at.tolist() == want_at


def test_edges(spark):
    df = spark.createDataFrame([], "vec_id long, v array<long>")
    got, at = centroids.cluster(df, 4)
    assert not got.count() and not len(at)
    far = spark.createDataFrame([(1, [1 << 40, 0])], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(far, 2)


def test_bounds_skip_most_centroids():
    r = np.random.default_rng(0)
    hubs = r.normal(0, 1, (8, 64))
    x = np.floor(1024 * (hubs[r.integers(0, 8, 4000)] + r.normal(0, 0.2, (4000, 64)))).astype(np.int64)
    c = np.floor(1024 * hubs).astype(np.int64)
    mean = x.mean(0)
    _, axes = np.linalg.eigh(np.cov(x.T))
    basis = axes[:, ::-1][:, :16]
    y, rest = centroids._rotated(x.astype(float), mean, basis)
    cluster, distance, tested = centroids.nearest(x, y, rest, c, mean, basis)
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all() and tested < 2 * len(x)


def test_query_columns(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(0, 1, 64)], 0) for i in range(40)]
    rows += [(50, None, 0), (51, [1.0] * 63, 0), (52, [float("nan")] * 64, 0), (53, [None] * 64, 0), (54, [float("inf")] * 64, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = centroids.query(spark, str(tmp_path)).collect()
    ints = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v, _ in rows[:40]]
    want, at = plain(ints, 64)
    assert sorted(((False, x.vec_id), x.cluster, x.distance) for x in got) == want
    for x in got:
        own = [d for _, j, d in want if j == x.cluster]
        assert (x.cluster_inertia, x.inertia) == (sum(own), sum(d for *_, d in want))
        assert x.centroid_sha256 == hashlib.sha256(",".join(map(str, at[x.cluster])).encode()).hexdigest()
