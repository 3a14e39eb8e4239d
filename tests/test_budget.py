import time

import pytest

from quarry.plans import evaluate, runs
from quarry.plans.budget import Budget


def _sleepy(spark, seconds=60):
    def wait(batches):
        import time

        for b in batches:
            time.sleep(seconds)
            yield b

    return spark.range(4).mapInPandas(wait, "id long")


def _df(spark, n=120):
    rows = [(i, float(i % 17), float((i * 7) % 23), int(i % 17 + (i * 7) % 23 / 2 > 12)) for i in range(n)]
    return spark.createDataFrame(rows, "id int, a double, b double, target int")


def test_a_running_job_ends_with_the_budget(spark):
    t0 = time.perf_counter()
    with pytest.raises(Exception, match="(?i)cancel"), Budget(spark, 2) as b:
        _sleepy(spark).count()
    assert time.perf_counter() - t0 < 6 and b.spent
    assert spark.range(10).count() == 10  # jobs outside are untouched


def test_an_unarmed_budget_lets_jobs_end(spark):
    with Budget(spark, 0, armed=False) as b:
        assert _sleepy(spark, 1).count() == 4
        b.arm()
        with pytest.raises(Exception, match="(?i)cancel"):
            _sleepy(spark).count()


PLANS = [{"plan_id": f"p{i}", "imputation": "mean", "outlier_handling": "none", "encoding": "onehot", "scaling": "none",
          "model": "logistic_regression", "imbalance_strategy": "none", "model_params": "{}"} for i in range(3)]


def _slow_from(monkeypatch, spark, first):
    """Plans from position ``first`` on take a minute, in the threads that fit their folds."""
    fit = evaluate.shared_fit

    def slow(fits, plan, *a):
        if int(plan["plan_id"][1:]) >= first:
            _sleepy(spark).count()
        return fit(fits, plan, *a)

    monkeypatch.setattr(evaluate, "shared_fit", slow)
    monkeypatch.setattr(runs, "_plans", lambda df: PLANS)


def test_search_cuts_the_plan_that_outlasts_the_budget(spark, monkeypatch):
    _slow_from(monkeypatch, spark, 1)
    ends = []
    select = runs.select_best
    monkeypatch.setattr(runs, "select_best", lambda a: ends.append(time.perf_counter()) or select(a))
    t0 = time.perf_counter()
    r = runs.run_budgeted_search(_df(spark), "target", ["id"], budget_s=40, cv=3)
    assert r.best_plan["plan_id"] == "p0" and ends[0] - t0 < 46
    cut = [a for a in r.attempts.collect() if a["error"]]
    assert [a["plan_id"] for a in cut] == ["p1"] and "cancel" in cut[0]["error"].lower()


def test_strict_search_ends_without_a_plan(spark, monkeypatch):
    _slow_from(monkeypatch, spark, 0)
    df = _df(spark).cache()
    df.count()
    t0 = time.perf_counter()
    with pytest.raises(ValueError):
        runs.run_budgeted_search(df, "target", ["id"], budget_s=15, cv=3, strict=True)
    assert time.perf_counter() - t0 < 20
