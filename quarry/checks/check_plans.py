"""Checks for plan generation, memory lookup and end-to-end runs (O-*, S-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.checks.inputs import DOCS_LABELLED_SQL, docs_labelled, docs_train
from quarry.checks.check_profile import DOCS_COLS, _issues_sql
from quarry.operators.issues import detect_issues
from quarry.plans.runs import run_rule_baseline
from quarry.plans.space import propose, rule_plan, search_space
from quarry.registry import r6, register, table
from quarry.sources.plan_memory import top_k_per_query

DIM = 64


@register(
    "rule_plan_documents",
    "WITH x AS (" + _issues_sql(DOCS_LABELLED_SQL, DOCS_COLS, "quality", "binary") + """)
SELECT 'rule_based' AS plan_id,
  CASE WHEN count_if(issue_type = 'high_missingness' AND severity = 'high') > 0 THEN 'knn' ELSE 'median' END AS imputation,
  CASE WHEN count_if(issue_type = 'outliers' AND severity = 'high') > 0 THEN 'winsorize' ELSE 'none' END AS outlier_handling,
  'onehot' AS encoding,
  CASE WHEN count_if(issue_type = 'outliers' AND severity = 'high') > 0 THEN 'robust' ELSE 'standard' END AS scaling,
  'logistic_regression' AS model,
  CASE WHEN count_if(issue_type = 'class_imbalance' AND severity IN ('high', 'medium')) > 0 THEN 'class_weight' ELSE 'none' END AS imbalance_strategy
FROM x""",
)
def q_rule_plan(spark, sf):
    """O-1: the rule baseline plan derived from the issues of documents + labels."""
    iss = detect_issues(docs_labelled(spark, sf), "quality")
    return rule_plan(iss, "binary").drop("model_params")


@register(
    "search_space_documents",
    """WITH t AS (SELECT count(DISTINCT quality) AS k FROM labels)
SELECT model, CAST(count(*) AS BIGINT) AS n_plans
FROM (SELECT * FROM (VALUES ('median'), ('mean'), ('knn'), ('iterative')) a(imputation),
      (VALUES ('winsorize'), ('none')) b(outlier_handling), (VALUES ('onehot'), ('target'), ('ordinal')) c(encoding),
      (VALUES ('standard'), ('robust'), ('minmax'), ('none')) d(scaling),
      (VALUES ('logistic_regression'), ('random_forest'), ('gradient_boosting'), ('xgboost'), ('lightgbm')) e(model),
      (VALUES ('class_weight'), ('smote'), ('none')) f(imbalance_strategy)) s, t
WHERE t.k <= 20
GROUP BY model""",
)
def q_search_space(spark, sf):
    """O-3: the option grid for the task type of the labels (classification: 1440 plans)."""
    from quarry.operators.profile import infer_target_type

    k = table(spark, sf, "labels").select("quality").distinct().count()
    task = infer_target_type("numeric", k)
    return search_space(spark, task).groupBy("model").agg(F.count(F.lit(1)).alias("n_plans"))


@register("candidate_plans_documents")
def q_candidates(spark, sf):
    """O-5: three new plans for documents + labels given its issues (rows-only)."""
    iss = detect_issues(docs_labelled(spark, sf), "quality")
    return propose(iss, None, None, "binary", n=3)


NN_SQL = f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
d AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, {DIM + 1}) r(i) GROUP BY label, i),
c AS (SELECT label AS query, list(m ORDER BY i) AS centroid FROM d GROUP BY label),
s AS (SELECT c.query, e.vec_id, list_cosine_similarity(e.v, c.centroid) AS sim FROM e, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM s)
SELECT CAST(query AS INTEGER) AS query, vec_id, R6(sim) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""


@register("nearest_to_centroids_embeddings", NN_SQL)
def q_nearest(spark, sf):
    """O-8: exact cosine top-3 of all embeddings for each label centroid (10 query vectors)."""
    e = table(spark, sf, "embeddings")
    cents = (
        e.select("label", F.posexplode("embedding").alias("i", "v"))
        .groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
        .collect()
    )
    queries = [(int(r["label"]), [x["m"] for x in r["c"]]) for r in cents]
    top = top_k_per_query(e.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "v", "vec_id", queries, 3)
    return top.select(F.col("query").cast("int").alias("query"), "vec_id", r6(F.col("similarity")).alias("similarity"),
                      F.col("rank").cast("int").alias("rank"))


@register("rule_baseline_documents_quality")
def q_rule_baseline_docs(spark, sf):
    """O-2: rule baseline end to end on labelled documents (binary target)."""
    r = run_rule_baseline(docs_train(spark, sf), "quality", ["doc_id"])
    return r.summary(spark)


@register("rule_baseline_orders_totalprice")
def q_rule_baseline_orders(spark, sf):
    """O-2: rule baseline end to end on orders (regression target)."""
    o = table(spark, sf, "orders").drop("o_orderdate")
    r = run_rule_baseline(o, "o_totalprice", ["o_orderkey"])
    return r.summary(spark)


@register(
    "missingness_chart_documents",
    "WITH t AS (" + DOCS_LABELLED_SQL + """),
m AS (SELECT 'doc_id' AS c, avg(CASE WHEN doc_id IS NULL THEN 1.0 ELSE 0 END) AS r FROM t
      UNION ALL SELECT 'lang', avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0 END) FROM t
      UNION ALL SELECT 'source', avg(CASE WHEN source IS NULL THEN 1.0 ELSE 0 END) FROM t
      UNION ALL SELECT 'n_chars', avg(CASE WHEN n_chars IS NULL THEN 1.0 ELSE 0 END) FROM t
      UNION ALL SELECT 'text', avg(CASE WHEN text IS NULL THEN 1.0 ELSE 0 END) FROM t
      UNION ALL SELECT 'quality', avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0 END) FROM t)
SELECT c AS column_name, R6(r) AS missing_rate, CAST(0.3 AS DOUBLE) AS threshold, r >= 0.3 AS above_threshold FROM m WHERE r > 0""",
)
def q_missingness_chart(spark, sf):
    """E-15: missingness chart data (columns with any missing value, 0.30 marker)."""
    from quarry.operators.profile import profile_columns
    from quarry.plans.compare import missingness_chart

    mc = missingness_chart(profile_columns(docs_labelled(spark, sf), with_values=False))
    return mc.select(F.col("column").alias("column_name"), r6(F.col("missing_rate")).alias("missing_rate"), "threshold",
                     "above_threshold")


@register(
    "dataset_summary_documents",
    "WITH x AS (" + _issues_sql(DOCS_LABELLED_SQL, DOCS_COLS, "quality", "binary") + "), t AS (" + DOCS_LABELLED_SQL + """),
m AS (SELECT count(*) AS n_rows,
             (avg(CASE WHEN doc_id IS NULL THEN 1.0 ELSE 0 END) + avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0 END)
              + avg(CASE WHEN source IS NULL THEN 1.0 ELSE 0 END) + avg(CASE WHEN n_chars IS NULL THEN 1.0 ELSE 0 END)
              + avg(CASE WHEN text IS NULL THEN 1.0 ELSE 0 END) + avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0 END)) / 6 AS mm,
             avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0 END) AS mx FROM t),
d AS (SELECT sum(n - 1) AS nd FROM (SELECT count(*) AS n FROM t GROUP BY doc_id, lang, source, n_chars, text, quality) g)
SELECT CAST(m.n_rows AS BIGINT) AS n_rows, 'quality' AS target_column, 'binary' AS target_type,
       round(CAST(d.nd AS DOUBLE) / m.n_rows, 4) AS duplicate_rate, 6 AS n_cols, CAST(3 AS BIGINT) AS n_numeric,
       CAST(3 AS BIGINT) AS n_categorical, round(CAST(m.mm AS DOUBLE), 4) AS avg_missing_rate,
       round(CAST(m.mx AS DOUBLE), 4) AS max_missing_rate,
       (SELECT CAST(count_if(severity = 'high') AS BIGINT) FROM x) AS n_high,
       (SELECT CAST(count_if(severity = 'medium') AS BIGINT) FROM x) AS n_medium,
       (SELECT CAST(count_if(severity = 'low') AS BIGINT) FROM x) AS n_low
FROM m, d""",
)
def q_dataset_summary(spark, sf):
    """O-14 / S-10: one-row dataset summary with issue counts (4 dp)."""
    from quarry.operators.profile import profile
    from quarry.plans.compare import dataset_summary

    df = docs_labelled(spark, sf)
    prof = profile(df, "quality")
    cols = spark.createDataFrame(prof.columns)
    iss = detect_issues(df, "quality", prof)
    out = dataset_summary(cols, prof.to_frame(spark), iss)
    return out.withColumn("n_cols", F.col("n_cols").cast("int"))
