"""Checks for splits, folds and metrics on deterministic synthetic predictions (E-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.folds import assign_kfold, assign_stratified, split
from quarry.operators.metrics import (
    BINARY_METRICS,
    MULTICLASS_METRICS,
    REGRESSION_METRICS,
    binary_metrics,
    composite_score,
    confusion,
    fold_average,
    fold_scores,
    multiclass_metrics,
    regression_metrics,
    roc_points,
)
from quarry.registry import r6, register, table


def _key_sql(cols, seed="42", salt="fold"):
    ks = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '␀')" for c in cols)
    return f"md5(concat_ws('|', '{seed}', '{salt}', concat_ws('|', {ks})))", f"concat_ws('|', {ks})"


# (l_orderkey, l_linenumber) repeats in the generated lineitem; this key is unique
LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
H_LI, KS_LI = _key_sql(LI_KEY)
H_SPLIT, _ = _key_sql(LI_KEY, salt="split")
H_ORD, _ = _key_sql(["o_orderkey"])


def _hex_unit(h):
    return f"CAST(('0x' || substr({h}, 1, 8)) AS BIGINT)"


@register(
    "holdout_split_lineitem",
    f"SELECT {', '.join(LI_KEY)}, ({_hex_unit(H_SPLIT)} % 1000) < 200 AS is_test FROM lineitem",
)
def q_split(spark, sf):
    """E-1: deterministic 80/20 hold-out by key hash."""
    li = table(spark, sf, "lineitem").select(*LI_KEY)
    tr, te = split(li, LI_KEY)
    return tr.withColumn("is_test", F.lit(False)).unionByName(te.withColumn("is_test", F.lit(True)))


@register("kfold_orders", f"SELECT o_orderkey, CAST({_hex_unit(H_ORD)} % 5 AS INTEGER) AS fold FROM orders")
def q_kfold(spark, sf):
    """E-2: shuffled k-fold (regression)."""
    return assign_kfold(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 5)


@register(
    "stratified_folds_lineitem",
    f"""SELECT {', '.join(LI_KEY)}, l_returnflag,
   CAST((row_number() OVER (PARTITION BY l_returnflag ORDER BY {H_LI}, {KS_LI}) - 1) % 5 AS INTEGER) AS fold
FROM lineitem""",
)
def q_stratified(spark, sf):
    """E-3: stratified 5-fold, exact per-class balance."""
    li = table(spark, sf, "lineitem").select(*LI_KEY, "l_returnflag")
    return assign_stratified(li, LI_KEY, "l_returnflag", 5)


# --- synthetic binary predictions on lineitem -------------------------------------
BIN_PRED_SQL = f"""
SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
       l_discount * 5 + l_tax * 2.5 AS score,
       CASE WHEN l_discount * 5 + l_tax * 2.5 >= 0.35 THEN 1 ELSE 0 END AS prediction,
       CAST((row_number() OVER (PARTITION BY CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END
                                ORDER BY {H_LI}, {KS_LI}) - 1) % 5 AS INTEGER) AS fold
FROM lineitem"""


def bin_preds(spark, sf):
    li = table(spark, sf, "lineitem")
    s = F.col("l_discount") * 5 + F.col("l_tax") * 2.5
    p = li.select(
        *LI_KEY,
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        s.alias("score"),
        F.when(s >= 0.35, 1).otherwise(0).alias("prediction"),
    )
    return assign_stratified(p, LI_KEY, "label", 5)


def _label_metrics_sql(preds_cte: str, binary: bool) -> str:
    sens = ""
    if binary:
        sens = """,
  CASE WHEN pos_tp + pos_fn > 0 THEN pos_tp / (pos_tp + pos_fn) END AS sensitivity,
  CASE WHEN neg_tp + neg_fn > 0 THEN neg_tp / (neg_tp + neg_fn) END AS specificity"""
    return f"""
p AS ({preds_cte}),
conf AS (SELECT fold, label, prediction, count(*) AS n FROM p GROUP BY ALL),
t AS (SELECT fold, label AS cls, sum(n) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp FROM conf GROUP BY ALL),
q AS (SELECT fold, prediction AS cls, sum(n) AS pred_n FROM conf GROUP BY ALL),
pc0 AS (SELECT coalesce(t.fold, q.fold) AS fold, coalesce(t.cls, q.cls) AS cls, coalesce(support, 0) AS support,
               coalesce(tp, 0) AS tp, coalesce(pred_n, 0) AS pred_n
        FROM t FULL OUTER JOIN q ON t.fold = q.fold AND t.cls = q.cls),
pc AS (SELECT *, pred_n - tp AS fp, support - tp AS fn,
              CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0 END AS prec,
              CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rec,
              CASE WHEN 2 * tp + (pred_n - tp) + (support - tp) > 0 THEN 2.0 * tp / (2 * tp + (pred_n - tp) + (support - tp)) ELSE 0 END AS f1,
              row_number() OVER (PARTITION BY fold ORDER BY cls DESC) AS desc_rank
       FROM pc0),
lm AS (SELECT fold, avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted,
              avg(prec) AS precision_macro, avg(rec) AS recall_macro, sum(tp) / sum(support) AS accuracy,
              avg(CASE WHEN support > 0 THEN tp / support END) AS balanced_accuracy,
              CAST(sum(tp) AS DOUBLE) AS c, CAST(sum(support) AS DOUBLE) AS s,
              sum(CAST(pred_n AS DOUBLE) * support) AS pt, sum(CAST(pred_n AS DOUBLE) * pred_n) AS pp,
              sum(CAST(support AS DOUBLE) * support) AS tt,
              max(CASE WHEN desc_rank = 1 THEN tp END) AS pos_tp, max(CASE WHEN desc_rank = 1 THEN fn END) AS pos_fn,
              max(CASE WHEN desc_rank = 2 THEN tp END) AS neg_tp, max(CASE WHEN desc_rank = 2 THEN fn END) AS neg_fn
       FROM pc GROUP BY fold),
lm2 AS (SELECT fold, f1_macro, f1_weighted, precision_macro, recall_macro, accuracy, balanced_accuracy,
  CASE WHEN (s * s - pp) * (s * s - tt) > 0 THEN (c * s - pt) / sqrt((s * s - pp) * (s * s - tt)) ELSE 0 END AS mcc,
  CASE WHEN pt / (s * s) < 1 THEN (c / s - pt / (s * s)) / (1 - pt / (s * s)) END AS cohen_kappa{sens}
  FROM lm)"""


def _auc_sql(src: str, group: str, score: str, pos: str) -> str:
    return f"""(SELECT {group}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS auc
  FROM (SELECT {group}, s, pos, neg, coalesce(sum(neg) OVER (PARTITION BY {group} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
        FROM (SELECT {group}, {score} AS s, sum(CASE WHEN {pos} THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN {pos} THEN 0 ELSE 1 END) AS neg
              FROM {src} GROUP BY ALL) g) r
  GROUP BY {group})"""


BIN_METRICS_SQL = f"""WITH {_label_metrics_sql(BIN_PRED_SQL, True)},
mx AS (SELECT fold, max(label) AS poslab FROM p GROUP BY fold),
pr AS (SELECT p.*, CAST(label = poslab AS DOUBLE) AS y, least(greatest(score, 1e-15), 1 - 1e-15) AS pc FROM p JOIN mx USING (fold)),
ll AS (SELECT fold, avg(-(y * ln(pc) + (1 - y) * ln(1 - pc))) AS log_loss, avg((score - y) * (score - y)) AS brier_score FROM pr GROUP BY fold),
au AS {_auc_sql('pr', 'fold', 'score', 'y = 1')}
SELECT lm2.fold, {', '.join(f'R6({m}) AS {m}' for m in BINARY_METRICS)}
FROM lm2 JOIN au USING (fold) JOIN ll USING (fold)"""


@register("binary_metrics_lineitem", BIN_METRICS_SQL)
def q_binary_metrics(spark, sf):
    """E-5, E-6, E-7: 13 binary metrics per stratified fold."""
    m = binary_metrics(bin_preds(spark, sf), ["fold"])
    return m.select("fold", *[r6(F.col(c)).alias(c) for c in BINARY_METRICS])


@register(
    "roc_points_lineitem",
    f"""WITH p AS ({BIN_PRED_SQL}),
g AS (SELECT fold, score, sum(label) AS pos, sum(1 - label) AS neg FROM p GROUP BY ALL),
c AS (SELECT fold, score, sum(pos) OVER (PARTITION BY fold ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             sum(neg) OVER (PARTITION BY fold ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
             sum(pos) OVER (PARTITION BY fold) AS P, sum(neg) OVER (PARTITION BY fold) AS N FROM g)
SELECT fold, R6(score) AS score, R6(fp / N) AS fpr, R6(tp / P) AS tpr FROM c""",
)
def q_roc(spark, sf):
    """E-18: ROC curve points per fold."""
    p = bin_preds(spark, sf)
    r = roc_points(p, ["fold"], "score", F.col("label") == 1)
    return r.select("fold", r6(F.col("score")).alias("score"), r6(F.col("fpr")).alias("fpr"), r6(F.col("tpr")).alias("tpr"))


@register(
    "confusion_lineitem",
    f"WITH p AS ({BIN_PRED_SQL}) SELECT fold, label, prediction, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ALL",
)
def q_confusion(spark, sf):
    """E-5: confusion counts per fold."""
    return confusion(bin_preds(spark, sf), ["fold"])


# --- synthetic multiclass predictions --------------------------------------------------
MC_PRED_SQL = f"""
SELECT l_returnflag AS label,
       [a / (a + b + c), b / (a + b + c), c / (a + b + c)] AS probs,
       CASE WHEN a >= b AND a >= c THEN 'A' WHEN b >= c THEN 'N' ELSE 'R' END AS prediction,
       CAST((row_number() OVER (PARTITION BY l_returnflag ORDER BY {H_LI}, {KS_LI}) - 1) % 5 AS INTEGER) AS fold
FROM (SELECT *, l_discount * 10 + 0.1 AS a, l_tax * 10 + 0.1 AS b, l_quantity / 50.0 AS c FROM lineitem) x"""


def mc_preds(spark, sf):
    li = table(spark, sf, "lineitem")
    a = F.col("l_discount") * 10 + 0.1
    b = F.col("l_tax") * 10 + 0.1
    c = F.col("l_quantity") / 50.0
    s = a + b + c
    p = li.select(
        *LI_KEY, F.col("l_returnflag").alias("label"),
        F.array(a / s, b / s, c / s).alias("probs"),
        F.when((a >= b) & (a >= c), "A").when(b >= c, "N").otherwise("R").alias("prediction"),
    )
    return assign_stratified(p, LI_KEY, "label", 5)


MC_METRICS_SQL = f"""WITH {_label_metrics_sql(MC_PRED_SQL, False)},
ex AS (SELECT fold, label, ['A', 'N', 'R'][i] AS cls, probs[i] AS pr FROM p, range(1, 4) r(i)),
au AS (SELECT fold, CASE WHEN count(auc) = count(*) THEN avg(auc) END AS auc_ovr FROM {_auc_sql('ex', 'fold, cls', 'pr', 'label = cls')} a GROUP BY fold),
ll AS (SELECT fold, avg(-ln(least(greatest(pr, 1e-15), 1 - 1e-15))) AS log_loss FROM ex WHERE label = cls GROUP BY fold),
br AS (SELECT fold, avg(b) AS brier_score FROM (SELECT fold, cls, avg((pr - CASE WHEN label = cls THEN 1.0 ELSE 0.0 END) ** 2) AS b FROM ex GROUP BY ALL) z GROUP BY fold)
SELECT lm2.fold, {', '.join(f'R6({m}) AS {m}' for m in MULTICLASS_METRICS)}
FROM lm2 JOIN au USING (fold) JOIN ll USING (fold) JOIN br USING (fold)"""


@register("multiclass_metrics_lineitem", MC_METRICS_SQL)
def q_multiclass_metrics(spark, sf):
    """E-8: 11 multiclass metrics per fold (OvR macro AUC, multiclass Brier)."""
    m = multiclass_metrics(mc_preds(spark, sf), ["fold"], ["A", "N", "R"])
    return m.select("fold", *[r6(F.col(c)).alias(c) for c in MULTICLASS_METRICS])


# --- synthetic regression predictions --------------------------------------------------
REG_PRED_SQL = f"""
SELECT o_totalprice AS label, o_totalprice * 0.9 + (o_custkey % 100) * 1000.0 AS prediction,
       CAST({_hex_unit(H_ORD)} % 5 AS INTEGER) AS fold
FROM orders"""


def reg_preds(spark, sf):
    o = table(spark, sf, "orders")
    p = o.select(
        "o_orderkey", F.col("o_totalprice").alias("label"),
        (F.col("o_totalprice") * 0.9 + (F.col("o_custkey") % 100) * 1000.0).alias("prediction"),
    )
    return assign_kfold(p, ["o_orderkey"], 5)


REG_METRICS_SQL = f"""WITH p AS ({REG_PRED_SQL}),
m AS (SELECT fold, 1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*)) AS r2,
             sqrt(avg((label - prediction) ** 2)) AS rmse, avg(abs(label - prediction)) AS mae,
             quantile_cont(abs(label - prediction), 0.5) AS median_ae,
             1 - var_pop(label - prediction) / var_pop(label) AS explained_variance,
             avg(CASE WHEN label <> 0 THEN abs((label - prediction) / label) END) * 100 AS mape
      FROM p GROUP BY fold)
SELECT fold, {', '.join(f'R6({m}) AS {m}' for m in REGRESSION_METRICS)} FROM m"""


@register("regression_metrics_orders", REG_METRICS_SQL)
def q_regression_metrics(spark, sf):
    """E-9: six regression metrics per fold."""
    m = regression_metrics(reg_preds(spark, sf), ["fold"])
    return m.select("fold", *[r6(F.col(c)).alias(c) for c in REGRESSION_METRICS])


@register(
    "cv_summary_orders",
    f"""WITH m AS ({REG_METRICS_SQL.replace('SELECT fold, ' + ', '.join(f'R6({m}) AS {m}' for m in REGRESSION_METRICS) + ' FROM m', 'SELECT * FROM m')})
SELECT {', '.join(f'R6(avg({m})) AS {m}' for m in REGRESSION_METRICS)}, R6(stddev_pop(r2)) AS cv_std,
       R6(avg(r2) - 0.5 * stddev_pop(r2) - 0.01 * 2) AS score FROM m""",
)
def q_cv_summary(spark, sf):
    """E-10..E-12: fold averages, population std of the primary, composite score (2 steps)."""
    per_fold = regression_metrics(reg_preds(spark, sf), ["fold"]).withColumn("__all", F.lit(1))
    avg = fold_average(per_fold, ["__all"], "regression")
    return avg.select(
        *[r6(F.col(c)).alias(c) for c in REGRESSION_METRICS],
        r6(F.col("cv_std")).alias("cv_std"),
        r6(composite_score(F.col("r2"), F.col("cv_std"), F.lit(2))).alias("score"),
    )


@register(
    "fold_scores_lineitem",
    f"""WITH m AS ({BIN_METRICS_SQL})
SELECT fold, f1_macro AS score, R6(avg(f1_macro) OVER ()) AS mean, R6(stddev_pop(f1_macro) OVER ()) AS std,
       f1_macro < avg(f1_macro) OVER () AS below_mean FROM m""",
)
def q_fold_scores(spark, sf):
    """E-19: per-fold primary metric against the mean over folds."""
    m = binary_metrics(bin_preds(spark, sf), ["fold"]).select("fold", r6(F.col("f1_macro")).alias("f1_macro"))
    fs = fold_scores(m.withColumn("__all", F.lit(1)), ["__all"], "f1_macro")
    return fs.select("fold", "score", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "below_mean")
