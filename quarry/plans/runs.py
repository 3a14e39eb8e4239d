"""End-to-end runs: baselines, the optimisation loop and the exploratory run.

(O-2, O-4, O-7, O-15, O-16, O-17, M-8, G-8.)  These are driver-side
compositions: every data step inside them is a Spark job from the operator
modules; the driver only holds per-column profiles, per-plan summaries and
the loop state.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.dtypes import column_types
from quarry.operators.folds import cross_folds, split
from quarry.operators.issues import clarification_questions, detect_issues
from quarry.operators.metrics import PRIMARY, task_metrics
from quarry.operators.models import build_pipeline
from quarry.operators.prep import PrepConfig, prepare
from quarry.operators.profile import profile as build_profile
from quarry.plans.budget import Budget
from quarry.plans.compare import run_facts
from quarry.plans.evaluate import Training, evaluate_plans, label_index, select_best, weighted
from quarry.plans.space import propose, rule_plan, sample_plans, search_space
from quarry.sources.attempt_log import AttemptLog
from quarry.sources.plan_memory import PlanMemory

# Fixed values of the optimisation loop.
MAX_ROUNDS = 3
PLANS_PER_ROUND = 3
CV_FOLDS = 5
SCORE_THRESHOLD = 0.90
MIN_IMPROVEMENT = 0.005
PLATEAU_ROUNDS = 2
SEARCH_TRIALS = 50
AUTOML_BUDGET_S = 60.0


@dataclass
class RunResult:
    method: str
    run_id: str
    best_plan: dict
    score: float
    metric_values: dict
    cv_std: float
    runtime_secs: float
    n_configs_evaluated: int
    attempts: DataFrame
    model: PipelineModel | None = None
    test_metrics: dict | None = None
    n_iterations: int = 1
    converged: bool = False
    questions: DataFrame | None = None
    profile: object = None
    issues: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    def facts(self) -> DataFrame:
        """S-11: the report facts of this run."""
        return run_facts(self)

    def summary(self, spark) -> DataFrame:
        """1-row run summary (best plan, score, metrics)."""
        return spark.createDataFrame(
            [(self.method, self.run_id, json.dumps(self.best_plan, sort_keys=True), float(self.score),
              {k: float(v) for k, v in (self.metric_values or {}).items()}, float(self.cv_std), float(self.runtime_secs),
              int(self.n_configs_evaluated), int(self.n_iterations), bool(self.converged),
              {k: float(v) for k, v in (self.test_metrics or {}).items() if v is not None})],
            "method string, run_id string, best_plan string, score double, metric_values map<string,double>, "
            "cv_std double, runtime_secs double, n_configs_evaluated int, n_iterations int, converged boolean, "
            "test_metrics map<string,double>",
        )


from contextlib import contextmanager

from pyspark import StorageLevel


@contextmanager
def persisted(*frames: DataFrame):
    """Persist frames for the duration of a run (every step re-reads them), then release."""
    held = [f.persist(StorageLevel.MEMORY_AND_DISK) for f in frames]
    try:
        yield held
    finally:
        for f in held:
            f.unpersist()


def domain_questions(df: DataFrame, issues: DataFrame, target: str | None, name: str = "data") -> DataFrame:
    """I-8 with V-8: clarification questions using the vocabulary's column wording.

    Column names are tagged (exact + fuzzy) and the 15 most frequent values
    of string columns are scanned; the domain question is asked first when
    the table's domain class is ambiguous.
    """
    from pyspark.sql import types as T

    from quarry.operators.profile import top_values, value_counts_long
    from quarry.operators.vocab import VALUE_TOP_N, catalog_of, column_questions, domain_question, table_domain, tag_columns

    spark = df.sparkSession
    feats = df.drop(target) if target else df
    strings = [f.name for f in feats.schema.fields if isinstance(f.dataType, T.StringType)]
    top = None
    if strings:
        sub = feats.select(*strings)
        names = spark.createDataFrame([(i, c) for i, c in enumerate(strings)], "ordinal int, column_name string")
        top = top_values(value_counts_long(sub), VALUE_TOP_N).join(F.broadcast(names), "ordinal").select(
            F.lit(name).alias("table_name"), "column_name", "value")
    tags = tag_columns(catalog_of({name: feats}), top)
    dq = domain_question(table_domain(tags)).select("question").collect()
    return clarification_questions(issues, target, domain_question=dq[0]["question"] if dq else None,
                                   column_questions=column_questions(tags).drop("table_name"))


def _plans(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def _features(df: DataFrame, target: str, key: list[str]) -> dict:
    return {c: t for c, t in column_types(df).items() if c != target and c not in key}


def fit_best(train: DataFrame, test: DataFrame | None, plan: dict, target: str, key: list[str], task: str,
             training: Training | None = None):
    """M-8: refit the plan on all training rows; optionally score the hold-out rows.

    With ``training`` the preprocessing is read off the statistics its evaluation counted.
    """
    model = training.refit(plan) if training is not None else None
    if model is not None:
        classes = training.classes
        n_classes = training.n_classes
    else:
        feats = _features(train, target, key)
        lab, classes = label_index(train.where(F.col(f"`{target}`").isNotNull()), target, task)
        n_classes = len(classes) if classes else 2
        lab = cross_folds(lab, key)
        weight = None
        if weighted(plan, task):
            from quarry.operators.features import class_weight_column

            lab = class_weight_column(lab, "label", "weight")
            weight = "weight"
        model = build_pipeline(plan, feats, task, n_classes, weight).fit(lab)
    test_metrics = None
    if test is not None:
        tl = test.where(F.col(f"`{target}`").isNotNull())
        if task != "regression":
            mapping = train.sparkSession.createDataFrame([(c, float(i)) for i, c in enumerate(classes)], ["__cls", "label"])
            tl = tl.join(F.broadcast(mapping), F.col(f"`{target}`") == F.col("__cls")).drop("__cls")
        else:
            tl = tl.withColumn("label", F.col(f"`{target}`").cast("double"))
        pred = model.transform(tl).withColumn("fold", F.lit(0))
        if task == "binary":
            pred = pred.withColumn("score", F.col("probs")[1])
        cls = list(range(n_classes)) if task == "multiclass" else None
        kw = {"score": "score"} if task == "binary" else {}
        row = task_metrics(pred, ["fold"], task, classes=cls, **kw).first()
        test_metrics = {k: v for k, v in row.asDict().items() if k != "fold"}
    return model, test_metrics


def _best_dict(best_row) -> dict:
    d = best_row.asDict()
    return {k: d[k] for k in ("plan_id", "imputation", "outlier_handling", "encoding", "scaling", "model",
                              "imbalance_strategy", "model_params")}


def run_rule_baseline(df: DataFrame, target: str, key: list[str], cv: int = CV_FOLDS, test_size: float = 0.2,
                      seed: int = 42) -> RunResult:
    """O-2: split -> profile -> issues -> rule plan -> CV -> refit (no preparation step)."""
    t0 = time.perf_counter()
    with persisted(*split(df, key, test_size, seed)) as (train, test):
        prof = build_profile(train, target)
        issues = detect_issues(train, target, prof)
        plan = _plans(rule_plan(issues, prof.target_type))
        with Training(train, target, key, prof.target_type, prof.dtypes(), cv, seed) as shared:
            attempts = evaluate_plans(train, plan, target, key, prof.target_type, prof.dtypes(), cv, seed, shared)
            best = select_best(attempts).first()
            model, test_metrics = fit_best(train, test, plan[0], target, key, prof.target_type, shared)
    return RunResult("rule_based", uuid.uuid4().hex[:12], _best_dict(best), best["score"], best["metric_values"],
                     best["cv_std"], time.perf_counter() - t0, 1, attempts, model, test_metrics,
                     profile=prof, issues=issues)


def run_random_search(df: DataFrame, target: str, key: list[str], n_trials: int = SEARCH_TRIALS, cv: int = CV_FOLDS,
                      test_size: float = 0.2, seed: int = 42, deadline_s: float | None = None,
                      method: str = "search_based", strict: bool = False) -> RunResult:
    """O-4 (and O-17 with a deadline): seeded sample of the space, CV each, keep the best.

    With ``deadline_s`` plans are evaluated one at a time until the wall-clock
    budget is used up; the plan that runs at that moment loses its Spark jobs
    and is recorded as failed (:class:`quarry.plans.budget.Budget`).  The first
    plan is not cut, so that there is a result; with ``strict`` it is, and a
    run without a finished plan raises.  The best plan is refitted after the
    budget.
    """
    t0 = time.perf_counter()
    with persisted(*split(df, key, test_size, seed)) as (train, test):
        return _random_search(train, test, t0, target, key, n_trials, cv, seed, deadline_s, method, strict)


def _within(budget: Budget, plans: list[dict], evaluate) -> list[DataFrame]:
    """Attempts of the plans, in order, until the budget is spent."""
    parts = []
    for p in plans:
        if budget.spent and budget.armed:
            break
        parts.append(evaluate(p).withColumn("position", F.lit(len(parts))))
        budget.arm()
    return parts


def _random_search(train, test, t0, target, key, n_trials, cv, seed, deadline_s, method, strict=False) -> RunResult:
    prof = build_profile(train, target)
    task = prof.target_type
    plans = _plans(sample_plans(search_space(train.sparkSession, task), n_trials, seed))
    dtypes = prof.dtypes()
    with Training(train, target, key, task, dtypes, cv, seed) as shared:
        if deadline_s is None:
            attempts = evaluate_plans(train, plans, target, key, task, dtypes, cv, seed, shared)
        else:
            with Budget(train.sparkSession, deadline_s, started=t0, armed=strict) as budget:
                parts = _within(budget, plans, lambda p: evaluate_plans(train, [p], target, key, task, dtypes, cv, seed, shared))
            if not parts:
                raise ValueError(f"the budget of {deadline_s} s was spent before the first plan")
            attempts = parts[0]
            for p in parts[1:]:
                attempts = attempts.unionByName(p)
        best = select_best(attempts).first()
        model, test_metrics = fit_best(train, test, _best_dict(best), target, key, task, shared)
    return RunResult(method, uuid.uuid4().hex[:12], _best_dict(best), best["score"], best["metric_values"],
                     best["cv_std"], time.perf_counter() - t0, attempts.count(), attempts, model, test_metrics,
                     profile=prof)


def run_budgeted_search(df: DataFrame, target: str, key: list[str], budget_s: float = AUTOML_BUDGET_S,
                        cv: int = CV_FOLDS, test_size: float = 0.2, seed: int = 42, strict: bool = False) -> RunResult:
    """O-17: search until the wall-clock budget expires (``strict``: also inside the first plan)."""
    return run_random_search(df, target, key, n_trials=10_000, cv=cv, test_size=test_size, seed=seed,
                             deadline_s=budget_s, method="budgeted_search", strict=strict)


def run_predictive(df: DataFrame, target: str, key: list[str], max_rounds: int = MAX_ROUNDS,
                   n_plans: int = PLANS_PER_ROUND, cv: int = CV_FOLDS, score_threshold: float = SCORE_THRESHOLD,
                   min_improvement: float = MIN_IMPROVEMENT, log_path: str | None = None,
                   memory_path: str | None = None, use_memory: bool = True, seed: int = 42,
                   proposer=None, prep: PrepConfig | None = None) -> RunResult:
    """O-7 / O-16: prepare -> split -> profile -> issues -> questions -> fingerprint ->
    memory lookup -> rounds of (propose, evaluate, persist, stop?) -> refit -> remember.

    ``proposer(issues, history, memory_plans, task, n, round_no)`` may replace
    the rule-based proposal step (it must return a plans DataFrame).
    Stops when the best score reaches ``score_threshold`` (converged) or after
    two consecutive rounds without an improvement above ``min_improvement``.
    """
    t0 = time.perf_counter()
    spark = df.sparkSession
    run_id = uuid.uuid4().hex[:12]
    clean, prep_report = prepare(df, target, prep)
    with persisted(*split(clean, key, 0.2, seed)) as (train, test):
        return _predictive(spark, run_id, t0, train, test, target, key, max_rounds, n_plans, cv, score_threshold,
                           min_improvement, log_path, memory_path, use_memory, seed, proposer, prep_report)


def _predictive(spark, run_id, t0, train, test, target, key, max_rounds, n_plans, cv, score_threshold,
                min_improvement, log_path, memory_path, use_memory, seed, proposer, prep_report) -> RunResult:
    prof = build_profile(train, target)
    task = prof.target_type
    issues = detect_issues(train, target, prof)
    questions = domain_questions(train, issues, target)
    fp = prof.fingerprint()
    memory = PlanMemory(spark, memory_path) if memory_path else None
    mem_plans = None
    if memory is not None and use_memory and memory.count() > 0:
        mem_plans = memory.similar(fp, 3).select("plan.*")
    log = AttemptLog(spark, log_path) if log_path else None
    history = None
    best, no_improve, converged, rounds = None, 0, False, 0
    all_attempts = []
    with Training(train, target, key, task, prof.dtypes(), cv, seed) as shared:
        for rnd in range(1, max_rounds + 1):
            rounds = rnd
            make = proposer or (lambda i, h, m, t, n, r: propose(i, h, m, t, n, seed, r))
            plans = _plans(make(issues, history, mem_plans, task, n_plans, rnd))
            attempts = evaluate_plans(train, plans, target, key, task, prof.dtypes(), cv, seed, shared)
            attempts = spark.createDataFrame(attempts.collect(), attempts.schema).withColumn("iteration", F.lit(rnd))
            all_attempts.append(attempts)
            if log is not None:
                log.append(run_id, rnd, attempts)
            hist_rows = attempts.select("model", "imputation", "encoding", "scaling")
            history = hist_rows if history is None else history.unionByName(hist_rows)
            try:
                rb = select_best(attempts).first()
            except ValueError:
                rb = None
            if rb is not None and (best is None or rb["score"] > best["score"] + min_improvement):
                best, no_improve = rb, 0
            else:
                no_improve += 1
            if best is not None and best["score"] >= score_threshold:
                converged = True
                break
            if no_improve >= PLATEAU_ROUNDS:
                break
        if best is None:
            raise ValueError("No successful evaluation results to select from")
        plan = _best_dict(best)
        model, test_metrics = fit_best(train, test, plan, target, key, task, shared)
    if memory is not None and use_memory:
        memory.append(fp, plan, dataset_name=target)
    attempts = all_attempts[0]
    for a in all_attempts[1:]:
        attempts = attempts.unionByName(a)
    return RunResult("agentic", run_id, plan, best["score"], best["metric_values"], best["cv_std"],
                     time.perf_counter() - t0, attempts.count(), attempts, model, test_metrics,
                     n_iterations=rounds, converged=converged, questions=questions, profile=prof, issues=issues,
                     extra={"prep_report": prep_report})


def run_exploratory(df: DataFrame, key: list[str], goal: str | None = None, method: str = "auto") -> dict:
    """O-15: profile (all columns) -> issues -> clusters -> questions; no model training."""
    from quarry.operators.cluster import discover_clusters, summarize_clusters

    t0 = time.perf_counter()
    prof = build_profile(df, None)
    issues = detect_issues(df, None, prof)
    questions = domain_questions(df, issues, None)
    feats = [c for c, t in prof.dtypes().items() if t == "numeric" and c not in key]
    clusters = discover_clusters(df, key, feats, method=method)
    summary = summarize_clusters(df, clusters.labels, key, feats) if clusters.labels is not None else None
    out = {"profile": prof, "issues": issues, "questions": questions, "clusters": clusters,
           "cluster_summary": summary, "goal": goal}
    return {**out, "facts": run_facts(out, clusters, summary), "runtime_secs": time.perf_counter() - t0}


def run_from_goal(df: DataFrame, goal: str, key: list[str], target: str | None = None, **kw):
    """G-8: route a plain-language goal to the exploratory or the predictive run.

    The goal is routed against this table's columns (G-1..G-7); exploratory
    goals run :func:`run_exploratory`, predictive goals need an explicit or a
    resolved target column and run :func:`run_predictive`.
    """
    from quarry.operators.goals import route, route_goals
    from quarry.operators.profile import profile_columns

    spark = df.sparkSession
    cols = [c for c in df.columns if c not in key]
    prof = {r["column"]: r for r in profile_columns(df.select(*cols), with_values=True).collect()}
    goals = spark.createDataFrame([(0, goal)], "goal_id int, text string")
    task = route_goals(goals, cols, {c: r["dtype"] for c, r in prof.items()},
                       {c: r["n_unique"] for c, r in prof.items()}).first()
    mode, resolved = route(task, target)
    if mode == "exploratory":
        return mode, task, run_exploratory(df, key, goal)
    return mode, task, run_predictive(df, resolved, key, **kw)
