"""Checks for profiling, duplicates and issue detection (A-*, D-*, I-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.checks.inputs import (
    DOCS_LABELLED_SQL,
    LINEITEM_MESSY_SQL,
    docs_labelled,
    lineitem_messy,
)
from quarry.operators.issues import detect_issues, issue_counts, clarification_questions
from quarry.operators.profile import (
    GOAL_REGRESSION_THRESHOLD,
    MULTICLASS_THRESHOLD,
    class_distribution,
    duplicate_count,
    profile,
    profile_columns,
    sample_values,
    top_values,
    value_counts_long,
)
from quarry.registry import r6, register, table

LINEITEM_COLS = [
    ("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"),
    ("l_linenumber", "numeric"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"),
    ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "categorical"),
    ("l_linestatus", "categorical"), ("l_shipdate", "datetime"),
]


def _profile_sql(src: str, cols) -> str:
    parts = []
    for c, t in cols:
        if t == "numeric":
            num = (
                f"R6(avg({c})) AS mean, R6(CASE WHEN count({c}) = 1 THEN 0.0 ELSE stddev_samp({c}) END) AS std, "
                f"R6(min({c})) AS min, R6(max({c})) AS max, "
                f"R6(quantile_cont({c}, 0.25)) AS q1, R6(quantile_cont({c}, 0.75)) AS q3"
            )
        else:
            num = ", ".join(f"CAST(NULL AS DOUBLE) AS {k}" for k in ("mean", "std", "min", "max", "q1", "q3"))
        parts.append(
            f"SELECT '{c}' AS column_name, '{t}' AS dtype, "
            f"R6(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)) AS missing_rate, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique, {num} FROM {src}"
        )
    return "\n UNION ALL ".join(parts)


def _profile_spark(df):
    p = profile_columns(df)
    return p.select(
        F.col("column").alias("column_name"), "dtype", r6(F.col("missing_rate")).alias("missing_rate"), "n_unique",
        *[r6(F.col(k)).alias(k) for k in ("mean", "std", "min", "max", "q1", "q3")],
    )


@register("profile_lineitem", _profile_sql("lineitem", LINEITEM_COLS))
def q_profile_lineitem(spark, sf):
    """A-1, A-2, A-4, A-5 on every lineitem column."""
    return _profile_spark(table(spark, sf, "lineitem"))


@register(
    "profile_lineitem_messy",
    "WITH li AS (" + LINEITEM_MESSY_SQL + ") "
    + _profile_sql(
        "li",
        [(c, t) for c, t in LINEITEM_COLS if c != "l_shipdate"]
        + [("l_line_id", "categorical"), ("l_netprice", "numeric")],
    ),
)
def q_profile_lineitem_messy(spark, sf):
    """Same stats with missing values, outliers and an identifier-like column."""
    return _profile_spark(lineitem_messy(spark, sf))


def _top_sql(src: str, cols, k: int) -> str:
    u = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {src}" for c in cols)
    return f"""
WITH u AS ({u}),
c AS (SELECT column_name, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY column_name, value),
r AS (SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM c)
SELECT column_name, value, CAST(n AS BIGINT) AS n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""


def _named(df, counts):
    names = df.sparkSession.createDataFrame(
        [(i, f.name) for i, f in enumerate(df.schema.fields)], "ordinal int, column string"
    )
    return counts.join(F.broadcast(names), "ordinal")


@register("top_categories_part", _top_sql("part", ["p_name", "p_brand", "p_type"], 10))
def q_top_categories_part(spark, sf):
    """A-6: ten most frequent values per categorical column, value tie-break."""
    df = table(spark, sf, "part").select("p_name", "p_brand", "p_type")
    top = top_values(value_counts_long(df), 10)
    return _named(df, top).select(F.col("column").alias("column_name"), "value", "n", F.col("rank").cast("int").alias("rank"))


@register("top_categories_orders", _top_sql("orders", ["o_orderstatus", "o_orderpriority", "o_custkey"], 10))
def q_top_categories_orders(spark, sf):
    """A-6 including a numeric key column (counts over its string form)."""
    df = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey")
    top = top_values(value_counts_long(df), 10)
    return _named(df, top).select(F.col("column").alias("column_name"), "value", "n", F.col("rank").cast("int").alias("rank"))


ORDERS_COLS = [
    ("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "categorical"),
    ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "categorical"),
]


def _samples_sql(src: str, cols) -> str:
    parts = []
    for c, t in cols:
        order = f"CAST(value AS DOUBLE), value" if t == "numeric" else "value"
        parts.append(
            f"SELECT '{c}' AS column_name, value, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank "
            f"FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS value FROM {src} WHERE {c} IS NOT NULL) s"
        )
    body = " UNION ALL ".join(f"({p})" for p in parts)
    return f"SELECT column_name, value, rank FROM ({body}) x WHERE rank <= 5"


@register("sample_values_orders", _samples_sql("orders", ORDERS_COLS))
def q_sample_values_orders(spark, sf):
    """A-3: five smallest distinct values per column (numeric order for numbers)."""
    df = table(spark, sf, "orders")
    numeric = [i for i, (c, t) in enumerate(ORDERS_COLS) if t == "numeric"]
    s = sample_values(value_counts_long(df), numeric)
    return _named(df, s).select(F.col("column").alias("column_name"), "value", F.col("rank").cast("int").alias("rank"))


@register(
    "class_distribution_returnflag",
    """
SELECT l_returnflag AS class, CAST(count(*) AS BIGINT) AS n,
       R6(count(*) / sum(count(*)) OVER ()) AS share
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""",
)
def q_class_distribution(spark, sf):
    """A-8: normalised class counts of a target."""
    cd = class_distribution(table(spark, sf, "lineitem"), "l_returnflag")
    return cd.select("class", "n", r6(F.col("share")).alias("share"))


def _target_types_sql(src, cols):
    parts = []
    for c, t in cols:
        nu = f"count(DISTINCT {c})"
        tt = (
            f"CASE WHEN '{t}' = 'numeric' AND {nu} > {MULTICLASS_THRESHOLD} THEN 'regression' "
            f"WHEN {nu} <= 2 THEN 'binary' ELSE 'multiclass' END"
        )
        gt = f"CASE WHEN '{t}' = 'numeric' AND {nu} > {GOAL_REGRESSION_THRESHOLD} THEN 'regression' ELSE 'classification' END"
        parts.append(f"SELECT '{c}' AS column_name, CAST({nu} AS BIGINT) AS n_unique, {tt} AS target_type, {gt} AS task_type FROM {src}")
    return " UNION ALL ".join(parts)


@register("target_types_lineitem", _target_types_sql("lineitem", LINEITEM_COLS))
def q_target_types(spark, sf):
    """A-7 (profile target type, 20-distinct cut) and A-14 (goal task type, 15-distinct cut)."""
    from quarry.operators.profile import target_type_expr

    p = profile_columns(table(spark, sf, "lineitem"))
    return p.select(
        F.col("column").alias("column_name"),
        "n_unique",
        target_type_expr(F.col("dtype"), F.col("n_unique")).alias("target_type"),
        F.when((F.col("dtype") == "numeric") & (F.col("n_unique") > GOAL_REGRESSION_THRESHOLD), "regression")
        .otherwise("classification")
        .alias("task_type"),
    )


@register(
    "duplicates_lineitem_flags",
    """
WITH t AS (SELECT l_returnflag, l_linestatus, l_linenumber, l_discount FROM lineitem),
g AS (SELECT count(*) AS n FROM t GROUP BY l_returnflag, l_linestatus, l_linenumber, l_discount)
SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates, CAST(sum(n) AS BIGINT) AS n_rows,
       R6(sum(n - 1) / greatest(sum(n), 1)) AS duplicate_rate FROM g""",
)
def q_duplicates(spark, sf):
    """D-2, D-3: duplicate rows over all columns of a projection."""
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_discount")
    d = duplicate_count(df)
    return d.select("n_duplicates", "n_rows", r6(F.col("duplicate_rate")).alias("duplicate_rate"))


@register(
    "fingerprint_documents_quality",
    "WITH t AS (" + DOCS_LABELLED_SQL + """),
m AS (
  SELECT count(*) AS n_rows,
         (avg(CASE WHEN doc_id IS NULL THEN 1.0 ELSE 0 END) + avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0 END)
          + avg(CASE WHEN source IS NULL THEN 1.0 ELSE 0 END) + avg(CASE WHEN n_chars IS NULL THEN 1.0 ELSE 0 END)
          + avg(CASE WHEN text IS NULL THEN 1.0 ELSE 0 END) + avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0 END)) / 6 AS mm,
         greatest(avg(CASE WHEN doc_id IS NULL THEN 1.0 ELSE 0 END), avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0 END),
          avg(CASE WHEN source IS NULL THEN 1.0 ELSE 0 END), avg(CASE WHEN n_chars IS NULL THEN 1.0 ELSE 0 END),
          avg(CASE WHEN text IS NULL THEN 1.0 ELSE 0 END), avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0 END)) AS mx
  FROM t),
c AS (SELECT quality, count(*) AS n FROM t WHERE quality IS NOT NULL GROUP BY quality),
s AS (SELECT max(n) * 1.0 / sum(n) AS pmax, min(n) * 1.0 / sum(n) AS pmin, count(*) AS k FROM c),
d AS (SELECT sum(n - 1) AS nd FROM (SELECT count(*) AS n FROM t GROUP BY doc_id, lang, source, n_chars, text, quality) g)
SELECT CAST(m.n_rows AS DOUBLE) AS fp0, CAST(6 AS DOUBLE) AS fp1, CAST(3 AS DOUBLE) AS fp2, CAST(3 AS DOUBLE) AS fp3, R6(m.mm) AS fp4,
       CAST(CASE WHEN s.k <= 2 THEN 0 ELSE 0.5 END AS DOUBLE) AS fp5,
       R6(least(s.pmax / (s.pmin + 1e-9), 100.0)) AS fp6,
       R6(d.nd / greatest(m.n_rows, 1)) AS fp7,
       round(CAST(m.mm AS DOUBLE), 4) AS avg_missing_rate, round(CAST(m.mx AS DOUBLE), 4) AS max_missing_rate
FROM m, s, d""",
)
def q_fingerprint(spark, sf):
    """A-9, A-10, A-12, A-13: table profile, fingerprint and missingness summary."""
    prof = profile(docs_labelled(spark, sf), "quality")
    fp = prof.fingerprint()
    miss = [r["missing_rate"] for r in prof.columns]
    names = [f"fp{i}" for i in range(8)]
    raw = spark.createDataFrame([tuple(float(v) for v in fp) + (sum(miss) / len(miss), max(miss))],
                                ", ".join(f"{n} double" for n in names + ["mm", "mx"]))
    return raw.select(*[r6(F.col(n)).alias(n) for n in names],
                      F.round("mm", 4).alias("avg_missing_rate"), F.round("mx", 4).alias("max_missing_rate"))


ISSUE_OUT = "issue_type, severity, affected_column, value"


def _issue_value():
    e = F.col("evidence")
    return r6(
        F.coalesce(e["missing_rate"], e["outlier_rate"], e["duplicate_rate"], e["cardinality_ratio"],
                   e["correlation"], e["minority_rate"])
    ).alias("value")


def _issues_spark(df, target):
    iss = detect_issues(df, target)
    return iss.select("issue_type", "severity", "affected_column", _issue_value(), "position")


def _missing_rule(src, c):
    m = f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)"
    return (
        f"SELECT 'high_missingness' AS issue_type, CASE WHEN {m} >= 0.30 THEN 'high' WHEN {m} >= 0.10 THEN 'medium' "
        f"WHEN {m} >= 0.01 THEN 'low' END AS severity, '{c}' AS affected_column, R6({m}) AS value, 0 AS det, {{ord}} AS ord FROM {src}"
    )


def _outlier_rule(src, c):
    return f"""SELECT 'outliers' AS issue_type, CASE WHEN rate >= 0.05 THEN 'high' WHEN rate >= 0.02 THEN 'medium' END AS severity,
 '{c}' AS affected_column, R6(rate) AS value, 1 AS det, {{ord}} AS ord FROM (
  SELECT count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / greatest(count({c}), 1) AS rate, q3 - q1 AS iqr
  FROM {src}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src}) b GROUP BY q1, q3) o WHERE iqr <> 0"""


def _noisy_rule(src, c):
    r = f"count(DISTINCT {c}) / greatest(count(*), 1)"
    return (
        f"SELECT 'noisy_categories' AS issue_type, CASE WHEN {r} >= 0.5 THEN 'medium' END AS severity, '{c}' AS affected_column, "
        f"R6({r}) AS value, 3 AS det, {{ord}} AS ord FROM {src}"
    )


def _leak_rule(src, c, y):
    pair = f"CASE WHEN {c} IS NOT NULL AND {y} IS NOT NULL"
    r = (
        f"abs(covar_pop({pair} THEN {c} END, {pair} THEN {y} END) / "
        f"nullif(stddev_pop({pair} THEN {c} END) * stddev_pop({pair} THEN {y} END), 0))"
    )
    return (
        f"SELECT 'leakage_candidate' AS issue_type, CASE WHEN count_if({c} IS NOT NULL AND {y} IS NOT NULL) < 10 THEN NULL "
        f"WHEN {r} >= 0.95 THEN 'high' WHEN {r} >= 0.90 THEN 'medium' END AS severity, '{c}' AS affected_column, "
        f"R6({r}) AS value, 4 AS det, {{ord}} AS ord FROM {src}"
    )


def _issues_sql(src_sql, cols, target, ttype):
    rules = []
    for i, (c, t) in enumerate(cols):
        rules.append(_missing_rule("t", c).replace("{ord}", str(i)))
        if t == "numeric":
            rules.append(_outlier_rule("t", c).replace("{ord}", str(i)))
            if ttype == "regression" and c != target:
                rules.append(_leak_rule("t", c, target).replace("{ord}", str(i)))
        if t == "categorical" and c != target:
            rules.append(_noisy_rule("t", c).replace("{ord}", str(i)))
    rules.append(
        "SELECT 'duplicates' AS issue_type, CASE WHEN r >= 0.01 THEN 'high' WHEN r >= 0.001 THEN 'medium' END, NULL, R6(r), 2, -1 "
        f"FROM (SELECT sum(n - 1) / greatest(sum(n), 1) AS r FROM (SELECT count(*) AS n FROM t GROUP BY {', '.join(c for c, _ in cols)}) g) d"
    )
    if ttype != "regression":
        tord = [c for c, _ in cols].index(target)
        rules.append(
            f"SELECT 'class_imbalance', CASE WHEN min(n) / sum(n) <= 0.10 THEN 'high' WHEN min(n) / sum(n) <= 0.20 THEN 'medium' END, "
            f"'{target}', R6(min(n) / sum(n)), 5, {tord} FROM (SELECT count(*) AS n FROM t WHERE {target} IS NOT NULL GROUP BY {target}) c"
        )
    body = "\n UNION ALL ".join(f"({r})" for r in rules)
    return f"""WITH t AS ({src_sql}), i AS ({body})
SELECT issue_type, severity, affected_column, value,
       CAST(row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, det, ord) AS INTEGER) AS position
FROM i WHERE severity IS NOT NULL"""


MESSY_COLS = [(c, t) for c, t in LINEITEM_COLS if c != "l_shipdate"] + [("l_line_id", "categorical"), ("l_netprice", "numeric")]
DOCS_COLS = [("doc_id", "numeric"), ("lang", "categorical"), ("source", "categorical"), ("n_chars", "numeric"),
             ("text", "categorical"), ("quality", "numeric")]


@register("issues_lineitem_messy", _issues_sql(LINEITEM_MESSY_SQL, MESSY_COLS, "l_extendedprice", "regression"))
def q_issues_lineitem(spark, sf):
    """I-1..I-7 for a regression target: missingness, outliers, identifiers, leakage."""
    return _issues_spark(lineitem_messy(spark, sf), "l_extendedprice")


@register("issues_documents_quality", _issues_sql(DOCS_LABELLED_SQL, DOCS_COLS, "quality", "binary"))
def q_issues_documents(spark, sf):
    """I-1..I-7 for a binary target: missing labels, skewed lengths, free text, imbalance."""
    return _issues_spark(docs_labelled(spark, sf), "quality")


@register(
    "issue_counts_documents_quality",
    "WITH x AS (" + _issues_sql(DOCS_LABELLED_SQL, DOCS_COLS, "quality", "binary") + """)
SELECT s.severity, CAST(count(x.severity) AS BIGINT) AS n_issues
FROM (VALUES ('high'), ('medium'), ('low')) s(severity) LEFT JOIN x ON x.severity = s.severity GROUP BY s.severity""",
)
def q_issue_counts(spark, sf):
    """I-9: issues per severity."""
    return issue_counts(detect_issues(docs_labelled(spark, sf), "quality")).select("severity", "n_issues")


@register(
    "questions_lineitem_messy",
    "WITH x AS (" + _issues_sql(LINEITEM_MESSY_SQL, MESSY_COLS, "l_extendedprice", "regression") + """)
SELECT issue_type, affected_column, CAST(row_number() OVER (ORDER BY position) AS INTEGER) AS position
FROM x WHERE severity = 'high' AND affected_column IS NOT NULL
  AND (issue_type IN ('leakage_candidate', 'noisy_categories') OR (issue_type = 'high_missingness' AND value > 0.40))
ORDER BY position LIMIT 4""",
)
def q_questions(spark, sf):
    """I-8: which HIGH issues become clarification questions (at most four)."""
    iss = detect_issues(lineitem_messy(spark, sf), "l_extendedprice")
    q = clarification_questions(iss, target="l_extendedprice")
    return q.select("issue_type", "affected_column", "position")
