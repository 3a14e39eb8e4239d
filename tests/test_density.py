"""DBSCAN on micro-cells against a brute-force version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions.graph import connected_components
from quarry.operators import density
from quarry.operators.density import dbscan, dbscan_sweep


def brute(points, eps, least):
    """{id: cluster} of (id, x...) rows by comparing all pairs."""
    live = {p[0]: p[1:] for p in points if all(v is not None and math.isfinite(v) for v in p[1:])}
    near = {i: [j for j, y in live.items() if sum((a - b) * (a - b) for a, b in zip(x, y)) <= eps * eps] for i, x in live.items()}
    core = {i for i in live if len(near[i]) >= least}
    label = {}
    for i in sorted(core):
        todo = [i] if i not in label else []
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = i
                todo += [k for k in near[j] if k in core]
    border = {i: min(label[j] for j in near[i] if j in core) for i in live if i not in core and any(j in core for j in near[i])}
    label |= border
    code = {c: n for n, c in enumerate(sorted(set(label.values())))}
    return {p[0]: code[label[p[0]]] if p[0] in label else -1 for p in points}


def run(spark, points, eps, least):
    cols = [f"x{i}" for i in range(len(points[0]) - 1)]
    df = spark.createDataFrame(points, "id long, " + ", ".join(f"{c} double" for c in cols))
    rows = dbscan(df, ["id"], cols, eps, least).collect()
    assert len(rows) == len(points)
    return {r["id"]: r["cluster"] for r in rows}


@pytest.mark.parametrize("dims,eps,least,seed", [(1, 0.05, 4, 1), (2, 0.3, 5, 2), (3, 0.6, 6, 3), (6, 1.6, 4, 4), (12, 2.4, 3, 5)])
def test_random_points(spark, dims, eps, least, seed):
    rng = random.Random(seed)
    centres = [[rng.uniform(-3, 3) for _ in range(dims)] for _ in range(4)]
    pts = [[c + rng.gauss(0, 0.4) for c in rng.choice(centres)] if rng.random() < 0.7 else [rng.uniform(-4, 4) for _ in range(dims)] for _ in range(350)]
    points = [(i * 3, *x) for i, x in enumerate(pts)] + [(5000 + i, *pts[0]) for i in range(6)]
    want = brute(points, eps, least)
    assert len(set(want.values())) > 2
    assert run(spark, points, eps, least) == want


def test_lattice_at_exactly_eps(spark):
    """Neighbours at distance eps exactly, on cell borders, with ties between clusters."""
    points = [(10 * i + j, float(i), float(j)) for i in range(6) for j in range(6) if i != 3 or j == 5]
    for least in (3, 5):
        assert run(spark, points, 1.0, least) == brute(points, 1.0, least)


@pytest.mark.parametrize("gap", [0.999, 1.001])
def test_dense_cells_side_by_side(spark, gap):
    """Two dense rings of rows whose closest rows decide the link: settled by descent, not by pairs."""
    n = 1500
    ring = [(0.3 * math.cos(2 * math.pi * i / n), 0.3 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    points = [(i, x, y) for i, (x, y) in enumerate(ring)] + [(n + i, x + 0.6 + gap, y) for i, (x, y) in enumerate(ring)]
    got = run(spark, points, 1.0, 5)
    assert set(got.values()) == ({0} if gap < 1 else {0, 1})


def test_one_ball_of_many_rows(spark):
    """40,000 rows within eps of each other, which as pairs would be 1.6 billion."""
    df = spark.range(40_000).select("id", (F.rand(1) * 0.7).alias("x"), (F.rand(2) * 0.7).alias("y"))
    got = dbscan(df, ["id"], ["x", "y"], 1.0, 5)
    assert [tuple(r) for r in got.groupBy("cluster").count().collect()] == [(0, 40_000)]


def test_null_nan_infinite_and_empty(spark):
    points = [(1, 0.0, 0.0), (2, 0.1, None), (3, 0.1, 0.0), (4, float("nan"), 0.0), (5, 0.0, 0.1), (6, float("inf"), 0.0)]
    assert run(spark, points, 0.5, 3) == {1: 0, 3: 0, 5: 0, 2: -1, 4: -1, 6: -1}
    empty = spark.createDataFrame([], "id long, x double")
    assert dbscan(empty, ["id"], ["x"], 0.5).collect() == []
    lost = spark.createDataFrame([(1, None)], "id long, x double")
    assert [tuple(r) for r in dbscan(lost, ["id"], ["x"], 0.5, 1).collect()] == [(1, -1)]
    with pytest.raises(ValueError):
        dbscan(empty, ["id"], ["x"], 0.0)


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(150)] + [(7, 7)]
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(400)) and all(got[1000 + i] == 1000 for i in range(151)) and len(got) == 551


@pytest.mark.parametrize("seed,eps,least", [(1, 0.02, 3), (2, 0.05, 4), (3, 0.2, 2), (4, 1.0, 5)])
def test_line_by_tiles(spark, monkeypatch, seed, eps, least):
    """On one axis every row is dealt once and to the borders of tiles, no cells are made; chains cross many tiles."""
    monkeypatch.setattr(density, "TILE_ROWS", 60)
    monkeypatch.setattr(density, "TILE_EPS", 8)
    monkeypatch.setattr(density, "_by_cells", lambda *_: pytest.fail("cells on one axis"))
    rng = random.Random(seed)
    xs = [rng.choice([rng.uniform(-30, 30), round(rng.uniform(-30, 30) / eps / 4) * eps, rng.uniform(-1, 1) * 6 * eps]) for _ in range(260)]
    xs = xs[: 200 if eps < 1 else 60] + [-20 + 0.9 * eps * i for i in range(60)]
    points = [((i * 37) % 1009, x) for i, x in enumerate(xs)] + [(2000, xs[0]), (2001, None), (2002, float("nan"))]
    if eps == 1.0:
        monkeypatch.setattr(density, "TILE_ROWS", 1000)
    want = brute(points, eps, least)
    assert run(spark, points, eps, least) == want


def test_many_dimensions_by_blocks(spark, monkeypatch):
    """Three eps of one sweep over blocks of vectors: counts, links and borders across blocks, copies as weights."""
    monkeypatch.setattr(density, "BLOCK_ROWS", (16, 40))
    monkeypatch.setattr(density, "_by_cells", lambda *_: pytest.fail("cells of many dimensions"))
    rng = random.Random(7)
    centres = [[rng.uniform(-2, 2) for _ in range(10)] for _ in range(5)]
    pts = [[c + rng.gauss(0, 0.3) for c in rng.choice(centres)] for _ in range(180)] + [[0.5 * i] + [4.0] * 9 for i in range(12)]
    points = [((i * 31) % 997, *x) for i, x in enumerate(pts)] + [(3000 + i, *pts[3]) for i in range(9)]
    df = spark.createDataFrame(points, "id long, " + ", ".join(f"x{i} double" for i in range(10)))
    epss = [0.1, 0.5, 1.3]
    for eps, got in zip(epss, dbscan_sweep(df, ["id"], [f"x{i}" for i in range(10)], epss, 3), strict=True):
        assert {r["id"]: r["cluster"] for r in got.collect()} == brute(points, eps, 3)


def test_repeated_keys_stay_with_cells(spark):
    points = [(1, 0.0), (1, 0.0), (2, 0.1), (3, 5.0)]
    df = spark.createDataFrame(points, "id long, x0 double")
    assert sorted(tuple(r) for r in dbscan(df, ["id"], ["x0"], 0.5, 3).collect()) == [(1, 0)] * 4 + [(2, 0), (3, -1)]
