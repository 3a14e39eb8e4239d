"""Pivotal mixing: targets by hand, sums kept, no bias, equal reruns."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        open_ = [s for s in names if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return {**share, **fixed}
        fixed.update({s: float(most * sizes[s]) for s in over})


WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for i in range(900):
        source = r.choices(["a", "B", "\U0001F600", "￿", "é", None, "tiny"], [40, 20, 8, 6, 8, 5, 1])[0]
        out.append((i, " ".join(["w"] * int(r.paretovariate(0.9) * 6 % 4000)), source))
    out += [(7, "one two three", "a")] * 9 + [(None, "four five", "B")] * 5 + [(None, None, None), (8000, None, "a"), (8001, "", "a"), (8002, " \t\x0b", "empty"), (8003, "w " * 60_000, "a")]
    return out


def frame(spark, rows, parts):
    shuffled = rows[:]
    random.Random(parts).shuffle(shuffled)
    return spark.createDataFrame([(*x, "clash") for x in shuffled], "doc_id long, text string, source string, size string").repartition(parts)


def test_mix(spark, rows):
    got = mixing.mix(frame(spark, rows, 3), leaf_rows=20, fan_in=3).collect()
    assert len(got) == len(rows)
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        largest[source] = max(largest[source], n)
    want, taken = plain_targets(sizes), defaultdict(int)
    for x in got:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source]
        assert x.taken == x.copies * x.size and 0 <= x.copies <= 3 and (x.size or not x.copies)
        rate = want[x.source] / sizes[x.source] if sizes[x.source] else 0
        assert not x.size or int(rate) <= x.copies <= int(rate) + 1
        taken[x.source] += x.taken
    for source in sizes:
        assert abs(taken[source] - want[source]) <= largest[source]
    assert abs(taken["B"] - want["B"]) < 0.02 * want["B"]
    spare = [x.copies for x in got if x.doc_id == 7 and x.size == 3]
    assert max(spare) - min(spare) <= 1
    key = lambda x: (x.source or "", x.doc_id or -1, x.size, x.copies)
    again = mixing.mix(frame(spark, rows, 5), leaf_rows=20, fan_in=3).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert not mixing.mix(df).count()
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(x.target, x.taken) for x in mixing.mix(df).collect()] == [(0.0, 0), (0.0, 0)]


def settle(size, p, draw, cut):
    n = len(size)
    table = pa.table({"number": pa.array([0] * n, pa.int32()), "node": pa.array([0] * n, pa.int32()), "size": pa.array(size, pa.int64()), "p": pa.array(p, pa.float64()), "draw": pa.array(draw, pa.float64()), "id": pa.array(range(n), pa.int64())})
    out = pa.Table.from_batches(list(mixing._pivot(iter(table.to_batches(max_chunksize=cut)))))
    return dict(zip(out["id"].to_pylist(), out["p"].to_pylist(), strict=True))


def test_steps_keep_words_and_probabilities():
    r = np.random.default_rng(6)
    size = sorted(r.integers(1, 500, 37).tolist(), reverse=True)
    p = r.random(37)
    mean = np.zeros(37)
    for k in range(3000):
        got = settle(size, p, r.random(37), 5 if k % 2 else 100)
        q = np.array([got[i] for i in range(37)])
        assert ((q > 0) & (q < 1)).sum() <= 1 and abs(q @ size - p @ size) < 1e-6
        mean += q
    assert np.abs(mean / 3000 - p).max() < 0.05


def test_batches_do_not_matter():
    r = np.random.default_rng(7)
    size, p, draw = [9] * 20, [0.4] * 20, r.random(20).tolist()
    assert settle(size, p, draw, 3) == settle(size, p, draw, 50)
    assert sum(settle(size, p, draw, 4).values()) == pytest.approx(8)


def test_repeated_blocks(spark):
    df = spark.createDataFrame([("a", 1), ("b", 7), ("c", 20)], "k string, n long")
    got = sorted((x.k, x.i) for x in mixing.repeated(df, "n", "i", block=5).collect())
    assert got == [("a", 0), *[("b", i) for i in range(7)], *[("c", i) for i in range(20)]]


def test_root_ends_near_its_words():
    r = np.random.default_rng(9)
    off = []
    for k in range(60):
        size = sorted((r.pareto(1.0, 40) * 100 + 1).astype(int).tolist(), reverse=True)
        p = [0.37] * 40
        got = mixing.landed(size, p, k)
        assert set(got) <= {0.0, 1.0}
        off.append(abs(sum(a * q for a, q in zip(size, got, strict=True)) - 0.37 * sum(size)) / max(size))
    assert np.median(off) < 0.02 and mixing.landed([5], [0.5], 1) in ([0.0], [1.0])
