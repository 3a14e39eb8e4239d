"""Evaluation metrics over a predictions frame (E-5 .. E-12, E-18, E-19).

A predictions frame has group columns (e.g. ``plan_id``, ``fold``), a
``label`` and a ``prediction`` column, and for probabilistic models either a
``score`` (binary: probability of the positive class) or ``probs``
(``array<double>`` aligned with the sorted class list).

Everything is computed from small aggregated tables:

* classification counts come from the confusion table
  ``groupBy(groups, label, prediction).count()``;
* AUC / ROC use score-grouped counts with a prefix scan over their global
  order, so no task holds all distinct scores of a fold;
* log-loss, Brier and the regression errors are plain averages;
* the median absolute error is selected exactly from per-fold value counts.

"Positive" in binary tasks is the larger label in sort order.  Group columns
are required (at least the fold); fold-level results are small tables.  Zero
divisions give 0 (precision/recall/F1), NULL for sensitivity/specificity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.ranking import running_totals

# Fixed values of the scoring rule.
CV_STD_PENALTY = 0.5
COMPLEXITY_PENALTY = 0.01
PROB_EPS = 1e-15

BINARY_METRICS = [
    "f1_macro", "f1_weighted", "precision_macro", "recall_macro", "sensitivity", "specificity",
    "accuracy", "balanced_accuracy", "mcc", "cohen_kappa", "auc", "log_loss", "brier_score",
]
MULTICLASS_METRICS = [
    "f1_macro", "f1_weighted", "precision_macro", "recall_macro", "accuracy", "balanced_accuracy",
    "mcc", "cohen_kappa", "auc_ovr", "log_loss", "brier_score",
]
REGRESSION_METRICS = ["r2", "rmse", "mae", "median_ae", "explained_variance", "mape"]
PRIMARY = {"binary": "f1_macro", "multiclass": "f1_macro", "regression": "r2"}


def _g(groups):
    return [F.col(g) for g in groups]


def confusion(preds: DataFrame, groups: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """E-5: (groups..., label, prediction, n)."""
    return preds.groupBy(*groups, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def per_class(conf: DataFrame, groups: list[str]) -> DataFrame:
    """tp, fp, fn, support for every class seen as label or prediction in the group."""
    t = conf.groupBy(*groups, F.col("label").alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp")
    )
    p = conf.groupBy(*groups, F.col("prediction").alias("cls")).agg(F.sum("n").alias("pred_n"))
    pc = t.join(p, [*groups, "cls"], "full_outer").na.fill(0, ["support", "tp", "pred_n"])
    return pc.withColumn("fp", F.col("pred_n") - F.col("tp")).withColumn("fn", F.col("support") - F.col("tp"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def label_metrics(conf: DataFrame, groups: list[str], binary: bool) -> DataFrame:
    """Confusion-derived metrics per group (f1/precision/recall/accuracy/mcc/kappa/...)."""
    pc = per_class(conf, groups)
    prec = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = _safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    pc = pc.withColumn("prec", prec).withColumn("rec", rec).withColumn("f1", f1)
    aggs = [
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.avg("prec").alias("precision_macro"),
        F.avg("rec").alias("recall_macro"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("tp") / F.col("support"))).alias("balanced_accuracy"),
        F.sum("tp").cast("double").alias("__c"),
        F.sum("support").cast("double").alias("__s"),
        F.sum(F.col("pred_n").cast("double") * F.col("support")).alias("__pt"),
        F.sum(F.col("pred_n").cast("double") * F.col("pred_n")).alias("__pp"),
        F.sum(F.col("support").cast("double") * F.col("support")).alias("__tt"),
    ]
    if binary:
        # positive = larger class label of the group; classes present in labels
        aggs += [
            F.max_by(F.struct("tp", "fn", "fp", "support"), F.col("cls")).alias("__pos"),
            F.min_by(F.struct("tp", "fn", "fp", "support"), F.col("cls")).alias("__neg"),
            F.count(F.lit(1)).alias("__k"),
        ]
    m = pc.groupBy(*groups).agg(*aggs)
    c, s, pt, pp, tt = (F.col(x) for x in ("__c", "__s", "__pt", "__pp", "__tt"))
    mcc_den = F.sqrt((s * s - pp) * (s * s - tt))
    m = m.withColumn("mcc", F.when(mcc_den > 0, (c * s - pt) / mcc_den).otherwise(F.lit(0.0)))
    pe = pt / (s * s)
    po = c / s
    m = m.withColumn("cohen_kappa", F.when(pe < 1, (po - pe) / (1 - pe)))
    if binary:
        tp, fn = F.col("__pos.tp"), F.col("__pos.fn")
        tn = F.col("__neg.tp")
        fp = F.col("__neg.fn")  # negatives predicted positive
        m = m.withColumn(
            "sensitivity", F.when((F.col("__k") == 2) & (tp + fn > 0), tp / (tp + fn))
        ).withColumn("specificity", F.when((F.col("__k") == 2) & (tn + fp > 0), tn / (tn + fp)))
        m = m.drop("__pos", "__neg", "__k")
    return m.drop("__c", "__s", "__pt", "__pp", "__tt")


def ranked_score_counts(preds: DataFrame, groups: list[str], score: str, positive: Column) -> DataFrame:
    """Per (groups, score): pos, neg and the counts of negatives/positives strictly below.

    The counts are made once, written in (groups, score) order with their
    running totals (:func:`quarry.functions.ranking.running_totals`), and the
    totals at the group's first score are taken off.  No group is held by one
    task.  Rows with a NULL group are left out; NULL scores count as largest.
    """
    g = preds.groupBy(*groups, F.col(score).alias("__s")).agg(
        F.sum(positive.cast("long")).alias("pos"), F.sum((~positive).cast("long")).alias("neg")
    ).fillna(0, ["pos", "neg"])
    run = running_totals(g, [*groups, "__s"], {"pos": "__rp", "neg": "__rn"})
    first = run.groupBy(*groups).agg(F.min("__rp").alias("__fp"), F.min("__rn").alias("__fn"))
    return run.join(first, groups).select(
        *groups,
        F.col("__s").alias("score"),
        "pos",
        "neg",
        (F.col("__rp") - F.col("__fp")).alias("pos_below"),
        (F.col("__rn") - F.col("__fn")).alias("neg_below"),
    )


def auc(preds: DataFrame, groups: list[str], score: str, positive: Column) -> DataFrame:
    """E-7: exact ROC AUC with ties (Mann-Whitney), NULL when a group has one class."""
    r = ranked_score_counts(preds, groups, score, positive)
    a = r.groupBy(*groups).agg(
        F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("__u"),
        F.sum("pos").alias("__p"),
        F.sum("neg").alias("__n"),
    )
    return a.select(
        *groups,
        F.when((F.col("__p") > 0) & (F.col("__n") > 0), F.col("__u") / (F.col("__p") * F.col("__n"))).alias("auc"),
    )


def roc_points(preds: DataFrame, groups: list[str], score: str, positive: Column) -> DataFrame:
    """E-18: one ROC point per distinct score, thresholding at ``score >= s``."""
    r = ranked_score_counts(preds, groups, score, positive)
    tot = r.groupBy(*groups).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = r.join(tot, groups)
    tp = F.col("P") - F.col("pos_below")
    fp = F.col("N") - F.col("neg_below")
    return j.select(
        *groups,
        "score",
        F.when(F.col("N") > 0, fp / F.col("N")).alias("fpr"),
        F.when(F.col("P") > 0, tp / F.col("P")).alias("tpr"),
    )


def _clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(PROB_EPS)), F.lit(1 - PROB_EPS))


def _materialised(fn):
    """Run a metric builder on a persisted input and return its (small) result materialised.

    The predictions frame feeds several aggregations (confusion table, AUC
    counts, probability averages); persisting it once avoids recomputing its
    lineage per consumer.  The result has one row per group.
    """
    import functools

    @functools.wraps(fn)
    def run(preds: DataFrame, *a, **kw):
        from pyspark import StorageLevel

        p = preds.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            res = fn(p, *a, **kw)
            return preds.sparkSession.createDataFrame(res.collect(), res.schema)
        finally:
            p.unpersist()

    return run


@_materialised
def binary_metrics(preds: DataFrame, groups: list[str], label: str = "label", prediction: str = "prediction",
                   score: str | None = "score") -> DataFrame:
    """E-6: the 13 binary metrics per group."""
    conf = confusion(preds, groups, label, prediction)
    m = label_metrics(conf, groups, binary=True)
    if score is None:
        for c in ("auc", "log_loss", "brier_score"):
            m = m.withColumn(c, F.lit(None).cast("double"))
        return m
    # positive class = larger label of the group (one row per group, bounded by the fold count)
    top = preds.groupBy(*groups).agg(F.max(label).alias("__poslab"), F.countDistinct(label).alias("__nl"))
    p = preds.join(top, groups)
    is_pos = F.col(label) == F.col("__poslab")
    y = is_pos.cast("double")
    pr = _clip(F.col(score))
    ll = p.groupBy(*groups).agg(
        F.avg(-(y * F.log(pr) + (1 - y) * F.log(1 - pr))).alias("log_loss"),
        F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier_score"),
        F.first("__nl").alias("__nl"),
    )
    ll = ll.withColumn("log_loss", F.when(F.col("__nl") == 2, F.col("log_loss"))).drop("__nl")
    a = auc(p, groups, score, is_pos)
    out = m.join(a, groups, "left").join(ll, groups, "left")
    return out.select(*groups, *BINARY_METRICS)


@_materialised
def multiclass_metrics(preds: DataFrame, groups: list[str], classes: list, label: str = "label",
                       prediction: str = "prediction", probs: str | None = "probs") -> DataFrame:
    """E-8: the 11 multiclass metrics; ``probs[i]`` is the probability of ``classes[i]``."""
    conf = confusion(preds, groups, label, prediction)
    m = label_metrics(conf, groups, binary=False)
    if probs is None:
        for c in ("auc_ovr", "log_loss", "brier_score"):
            m = m.withColumn(c, F.lit(None).cast("double"))
        return m.select(*groups, *MULTICLASS_METRICS)
    cls_arr = F.array(*[F.lit(c) for c in classes])
    ex = preds.select(
        *groups, F.col(label).alias("__y"),
        F.posexplode(F.col(probs)).alias("__i", "__p"),
    ).withColumn("__c", cls_arr[F.col("__i")])
    hit = (F.col("__y") == F.col("__c"))
    # one-vs-rest AUC per class, then macro mean over classes present in the group
    ova = auc(ex, [*groups, "__c"], "__p", hit)
    auc_ovr = ova.groupBy(*groups).agg(F.avg("auc").alias("auc_ovr"), F.count_if(F.col("auc").isNull()).alias("__bad"))
    auc_ovr = auc_ovr.withColumn("auc_ovr", F.when(F.col("__bad") == 0, F.col("auc_ovr"))).drop("__bad")
    per_row = ex.groupBy(*groups, "__c").agg(F.avg((F.col("__p") - hit.cast("double")) ** 2).alias("__b"))
    brier = per_row.groupBy(*groups).agg(F.avg("__b").alias("brier_score"))
    ll = ex.where(hit).groupBy(*groups).agg(F.avg(-F.log(_clip(F.col("__p")))).alias("log_loss"))
    out = m
    for part in (auc_ovr, ll, brier):
        out = out.join(part, groups, "left")
    return out.select(*groups, *MULTICLASS_METRICS)


def regression_metrics(preds: DataFrame, groups: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """E-9: r2, rmse, mae, median_ae, explained_variance, mape (x100, zero targets skipped)."""
    y, yh = F.col(label).cast("double"), F.col(prediction).cast("double")
    err = y - yh
    m = preds.groupBy(*groups).agg(
        F.sum(err * err).alias("__ssr"),
        F.var_pop(y).alias("__vy"),
        F.count(F.lit(1)).alias("__n"),
        F.avg(err * err).alias("__mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.var_pop(err).alias("__ve"),
        F.avg(F.when(y != 0, F.abs(err / y))).alias("__mape"),
    )
    m = m.join(group_medians(preds, groups, F.abs(err)), groups, "left")
    sst = F.col("__vy") * F.col("__n")
    return m.select(
        *groups,
        F.when(sst > 0, 1 - F.col("__ssr") / sst).otherwise(F.when(F.col("__ssr") == 0, 1.0).otherwise(0.0)).alias("r2"),
        F.sqrt("__mse").alias("rmse"),
        "mae",
        "median_ae",
        F.when(F.col("__vy") > 0, 1 - F.col("__ve") / F.col("__vy"))
        .otherwise(F.when(F.col("__ve") == 0, 1.0).otherwise(0.0)).alias("explained_variance"),
        (F.col("__mape") * 100).alias("mape"),
    )


def group_medians(preds: DataFrame, groups: list[str], x: Column) -> DataFrame:
    """Exact median of ``x`` per group (``median_ae``) without the ``percentile`` aggregate.

    Per-group value counts, then the histogram-descent selection of
    :func:`quarry.functions.stats.exact_quantiles`; groups (folds x plans)
    are a small table.
    """
    from pyspark import StorageLevel

    from quarry.functions.stats import exact_quantiles

    spark = preds.sparkSession
    counts = preds.groupBy(*groups, x.alias("__v")).agg(F.count(F.lit(1)).alias("__c")).where(F.col("__v").isNotNull())
    keys = [tuple(r) for r in preds.select(*groups).distinct().collect()]
    ids = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], ["ordinal", *groups])
    c = counts.join(F.broadcast(ids), groups).select("ordinal", F.col("__v").alias("v"), F.col("__c").alias("n")).persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        st = c.groupBy("ordinal").agg(F.sum("n").alias("N"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        med = exact_quantiles(c, [(r["ordinal"], int(r["N"]), r["lo"], r["hi"]) for r in st], [0.5])
    finally:
        c.unpersist()
    rows = [(*k, med.get((i, 0.5))) for i, k in enumerate(keys)]
    schema = ", ".join(f"`{g}` {preds.schema[g].dataType.simpleString()}" for g in groups) + ", median_ae double"
    return spark.createDataFrame(rows, schema)


def task_metrics(preds: DataFrame, groups: list[str], task: str, classes: list | None = None, **kw) -> DataFrame:
    """Dispatch on task type.  ``groups`` must be non-empty (e.g. ``["fold"]``)."""
    if task == "binary":
        return binary_metrics(preds, groups, **kw)
    if task == "multiclass":
        return multiclass_metrics(preds, groups, classes, **kw)
    return regression_metrics(preds, groups, **kw)


def fold_average(per_fold: DataFrame, groups: list[str], task: str) -> DataFrame:
    """E-10: mean of each metric over folds (NULL folds skipped) and population std of the primary."""
    names = {"binary": BINARY_METRICS, "multiclass": MULTICLASS_METRICS, "regression": REGRESSION_METRICS}[task]
    prim = PRIMARY[task]
    return per_fold.groupBy(*groups).agg(
        *[F.avg(c).alias(c) for c in names],
        F.stddev_pop(prim).alias("cv_std"),
        F.count(F.lit(1)).alias("n_folds"),
    )


def step_count(has_numeric: bool, has_categorical: bool) -> int:
    """E-11: column groups present plus one model."""
    return int(has_numeric) + int(has_categorical) + 1


def composite_score(primary: Column, cv_std: Column, steps: Column) -> Column:
    """E-12: primary - 0.5 * cv_std - 0.01 * steps."""
    return primary - CV_STD_PENALTY * cv_std - COMPLEXITY_PENALTY * steps


def fold_scores(per_fold: DataFrame, groups: list[str], primary: str) -> DataFrame:
    """E-19: per-fold primary metric with the mean/std over folds and a below-mean flag."""
    stats = per_fold.groupBy(*groups).agg(F.avg(primary).alias("mean"), F.stddev_pop(primary).alias("std"))
    j = per_fold.join(stats, groups)
    return j.select(
        *groups, "fold", F.col(primary).alias("score"), "mean", "std", (F.col(primary) < F.col("mean")).alias("below_mean")
    )
