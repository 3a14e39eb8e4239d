"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import periodic


def brute(a, least=6, exponent=4):
    """Every period in turn: stretches of words equal at that distance; the smallest period of a stretch counts."""
    n, found = len(a), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and a[j] == a[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def odd_sequence(r):
    n, letters = r.randint(0, 70), r.randint(1, 4)
    a = [r.randrange(letters) for _ in range(n)]
    for _ in range(r.randint(0, 2)):
        if n > 8:
            s, p = r.randrange(n), r.randint(1, 9)
            stop = r.randint(s, n)
            a = [a[s + (i - s) % p] if s <= i < stop else a[i] for i in range(n)]
    return a


def test_runs_against_brute_force():
    r = random.Random(5)
    for _ in range(1500):
        a = odd_sequence(r)
        assert periodic.find_runs(np.array(a, np.int64)) == brute(a), a
    for _ in range(200):
        a = odd_sequence(r)
        assert periodic.find_runs(np.array(a, np.int64), 12, 3) == brute(a, 12, 3), a


def test_long_repetitions():
    assert periodic.find_runs(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]
    assert periodic.find_runs(np.arange(30_001) % 1000) == [(0, 30_001, 1000)]
    fib = [0, 1]
    while len(fib) < 400:
        fib = fib + fib[: len(fib) - fib[::-1].index(1) % 2 - 1]
    assert periodic.find_runs(np.array(fib[:400])) == brute(fib[:400])


def test_blocks_split_and_keep_neighbours(monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 3)
    r = random.Random(2)
    held, order = None, list(range(200))
    r.shuffle(order)
    seen = []
    for x in order:
        if held is None:
            held = periodic.Positions(x)
        else:
            assert held.insert(x) == (max((y for y in seen if y < x), default=None), min((y for y in seen if y > x), default=None))
        seen.append(x)
    assert [x for b in held.blocks for x in b] == sorted(order)


SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(doc_id, text):
    words = SPACE_WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest(),
    )


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["ab", "Ab", "ö", "c-d", "e"]) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n\x0b "), (2003, "a a a a a a a"), (None, "x y x y x y x y"), (2004, "\x85 \x85 \x85 \x85 \x85 \x85 \x85"), (2004, "\x85 \x85 \x85 \x85 \x85 \x85 \x85")]
    rows += [(i, " ".join(map(str, range(40)))) for i in range(3000, 3060)]  # a tenth is made periodic
    rows += [(4000, ("q w e " * 9000) + "tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit(1))
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in periodic.query(spark, str(tmp_path)).collect()]
    key = lambda t: tuple((x is None, x) for x in t)
    small = [expected(*x) for x in rows if x[0] != 4000]
    assert sorted((x for x in got if x[0] != 4000), key=key) == sorted(small, key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(3000, 3060)) and any(x[1] for x in got if x[0] and 3000 <= x[0] < 3060)
    long = next(x for x in got if x[0] == 4000)
    if zlib.crc32(b"4000") % 10:
        assert long[1:6] == (1, 0, 27000, 3, 9_000_000)
    assert periodic.query(spark, str(tmp_path)).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_operator_outputs(spark):
    df = spark.createDataFrame([("x", "a b a b a b a b c", 1), (None, None, 2)], "`odd ``name` string, text string, n_words int")
    got = periodic.periodic_runs(df, ["odd `name"]).collect()
    assert {(r[0], r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got} == {("x", 9, ((0, 8, 2),), "a b c"), (None, 0, (), "")}
    assert not periodic.periodic_runs(df.limit(0), ["odd `name"]).count()
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, ["n_words"])
