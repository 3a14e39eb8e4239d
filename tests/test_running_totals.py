import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions.ranking import running_totals
from quarry.operators.metrics import auc, ranked_score_counts


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_totals_of_all_rows_before(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.choice("ab"), i, rnd.randrange(1 << 40), rnd.randrange(3)) for i in range(n)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, v long, w long").repartition(5)
    got = {(r["g"], r["i"]): (r["bv"], r["bw"]) for r in running_totals(df, ["g", "i"], {"v": "bv", "w": "bw"}).collect()}
    v = w = 0
    for g, i, a, b in sorted(rows):
        assert got[g, i] == (v, w)
        v, w = v + a, w + b
    assert len(got) == n


def test_totals_survive_the_batches_of_one_partition(spark):
    df = spark.range(30_000).coalesce(1).select("id", F.lit(1).cast("long").alias("one"))
    out = running_totals(df, ["id"], {"one": "before"})
    assert out.where(F.col("before") != F.col("id")).count() == 0 and out.count() == 30_000


def test_ranked_counts_and_auc_by_pairs(spark):
    rnd = random.Random(2)
    rows = [(f, rnd.choice([0.0, 0.25, 0.25, 1.0, rnd.random()]), rnd.randrange(2)) for f in (0, 0, 0, 1, 2) for _ in range(60)]
    rows += [(3, 0.5, 1)]
    df = spark.createDataFrame(rows, "fold int, score double, y int")
    for r in ranked_score_counts(df, ["fold"], "score", F.col("y") == 1).collect():
        below = [y for f, s, y in rows if f == r["fold"] and s < r["score"]]
        assert (r["pos_below"], r["neg_below"]) == (sum(below), len(below) - sum(below))
    for fold, got in auc(df, ["fold"], "score", F.col("y") == 1).collect():
        pos = [s for f, s, y in rows if f == fold and y]
        neg = [s for f, s, y in rows if f == fold and not y]
        if not neg:
            assert got is None
            continue
        wins = sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg))
        assert got == pytest.approx(wins / len(pos) / len(neg))
