"""Exact neighbours by box descent against a brute-force version."""

import math
import random

import pytest

from quarry.operators import nearest as module
from quarry.operators.nearest import nearest


def brute(receivers, donors, dims, k):
    """{(rid, j): [(dist, did)]} by comparing every donor."""
    out = {}
    for rid, x, targets in receivers:
        for j in targets:
            scored = []
            for did, y in donors:
                shared = [(a - b) * (a - b) for a, b in zip(x, y) if a is not None and b is not None]
                if shared and did != rid and (j < 0 or y[j] is not None):
                    total = 0.0
                    for s in shared:
                        total += s
                    scored.append((math.sqrt(total * float(dims) / len(shared)), did))
            if scored:
                out[rid, j] = sorted(scored)[:k]
    return out


def run(spark, receivers, donors, dims, k):
    r = spark.createDataFrame(receivers, "rid string, rv array<double>, tgt array<int>")
    d = spark.createDataFrame(donors, "did string, dv array<double>")
    out, found = {}, nearest(r, d, dims, k)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    for row in found.orderBy("rid", "j", "rank").collect():
        out.setdefault((row["rid"], row["j"]), []).append((row["dist"], row["did"]))
    return out


def table(n, dims, gaps, seed):
    rng = random.Random(seed)
    scale = [10.0 ** (i % 3) for i in range(dims)]
    return [[None if rng.random() < gaps else round(rng.gauss(0, s), 3) for s in scale] for _ in range(n)]


@pytest.mark.parametrize("n,dims,gaps,k", [(1500, 4, 0.1, 5), (600, 3, 0.5, 3), (900, 2, 0.0, 4)])
def test_gaps_in_every_column(spark, n, dims, gaps, k, monkeypatch):
    plans = []
    kept = module.checkpoint

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(module, "checkpoint", watched)
    xs = table(n, dims, gaps, n)
    donors = [(f"d{i:05d}", x) for i, x in enumerate(xs)]
    asked = [(f"r{i:05d}", x, [j for j in range(dims) if x[j] is None] or [-1]) for i, x in enumerate(xs[:120])]
    got, want = run(spark, asked, donors, dims, k), brute(asked, donors, dims, k)
    assert got.keys() == want.keys()
    for key in want:
        assert [d for _, d in got[key]] == [d for _, d in want[key]], key
    assert len(plans) >= 4 and not any("NestedLoop" in p or "Cartesian" in p for p in plans)


def test_hot_vectors_ties_and_self(spark):
    """A vector of a third of all donors counts as often as it stands, up to k; a request is not its own neighbour."""
    xs = table(500, 2, 0.1, 9)
    donors = [(f"d{i:05d}", x) for i, x in enumerate(xs)] + [("hot", [0.5, 0.5])] * 250
    got = run(spark, [("hot", [0.5, 0.5], [-1]), ("near", [0.5, None], [1])], donors, 2, 4)
    assert [d for _, d in got["near", 1]] == ["hot"] * 4 and "hot" not in [d for _, d in got["hot", -1]]
    lone = [(f"d{i:05d}", x) for i, x in enumerate(xs)]
    assert got["hot", -1] == brute([("hot", [0.5, 0.5], [-1])], lone, 2, 4)["hot", -1]
    ties = [(f"t{i:03d}", [float(i % 2), 0.0]) for i in range(300)]
    assert [d for _, d in run(spark, [("r", [0.5, 0.0], [-1])], ties, 2, 3)["r", -1]] == ["t000", "t001", "t002"]


def test_empty_and_unusable(spark):
    donors = [("a", [1.0, None]), ("b", [float("nan"), float("inf")]), ("c", [None, 2.0])]
    assert run(spark, [], donors, 2, 3) == {} and run(spark, [("r", [1.0, None], [1])], [], 2, 3) == {}
    assert run(spark, [("r", [1.0, None], [1]), ("s", [None, None], [0, 1])], donors, 2, 3) == {}
    assert run(spark, [("r", [1.0, None], [-1])], donors, 2, 3) == {("r", -1): [(0.0, "a")]}


def test_many_leaves_and_bounded_rows(spark, monkeypatch):
    """Trees of small leaves over shared coordinates: exact, and what is kept stays near the number of requests and donors."""
    monkeypatch.setattr(module, "LEAF_ROWS", 16)
    monkeypatch.setattr(module, "DEAL_ROWS", 20, raising=False)
    monkeypatch.setattr(module, "BLOCK", 300, raising=False)
    rows, stored = [], module.checkpoint

    def counted(df):
        out = stored(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(module, "checkpoint", counted)
    rng = random.Random(5)
    # the widest coordinate is the one that the requests lack; another has few values
    donors = [(f"d{i:05d}", [rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0]), rng.gauss(0, 1000)]) for i in range(1200)]
    donors += [(f"e{i:05d}", [None, rng.choice([0.0, 1.0, 2.0]), rng.gauss(0, 1000)]) for i in range(200)]
    asked = [(f"r{i:05d}", [rng.gauss(0, 1.2), rng.choice([0.0, 1.0, 5.0]), None], [2]) for i in range(150)]
    asked += [(f"s{i:05d}", [None, rng.choice([0.0, 1.0, 2.0]), None], [0, 2]) for i in range(60)]
    got, want = run(spark, asked, donors, 3, 5), brute(asked, donors, 3, 5)
    assert got.keys() == want.keys()
    for key in want:
        assert [d for _, d in got[key]] == [d for _, d in want[key]] and got[key][0][0] == want[key][0][0], key
    assert max(rows) <= 3 * (len(asked) + len(donors)) and sum(rows) <= 6 * (len(asked) + len(donors))
