"""Checks for the feature-stage fits (F-*): fitted parameters and transformed rows."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quarry.checks.check_eval import LI_KEY
from quarry.checks.inputs import LINEITEM_MESSY_SQL, docs_train, lineitem_messy
from quarry.operators import features as FE
from quarry.operators.folds import cross_folds
from quarry.registry import r6, register, table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _param_rows(spark, rows):
    return spark.createDataFrame(rows, "column_name string, a double, b double").select(
        "column_name", r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"))


def _params_sql(exprs_a, exprs_b, src="li"):
    parts = [f"SELECT '{c}' AS column_name, R6({exprs_a.format(c=c)}) AS a, R6({exprs_b.format(c=c)}) AS b FROM {src}"
             for c in NUM]
    return "WITH li AS (" + LINEITEM_MESSY_SQL + ") " + " UNION ALL ".join(parts)


@register("impute_fit_lineitem", _params_sql("avg({c})", "quantile_cont({c}, 0.5)"))
def q_impute_fit(spark, sf):
    """F-3: fitted mean (a) and exact median (b) per numeric column (with missing values)."""
    df = lineitem_messy(spark, sf)
    mean = FE.SimpleImpute(NUM, "mean").fit(df).values
    med = FE.SimpleImpute(NUM, "median").fit(df).values
    return _param_rows(spark, [(c, mean[c], med[c]) for c in NUM])


@register(
    "winsor_bounds_lineitem",
    _params_sql("quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))",
                "quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"),
)
def q_winsor(spark, sf):
    """F-7: fitted clipping fence (a = lower, b = upper) per column."""
    b = FE.Winsorizer(NUM).fit(lineitem_messy(spark, sf)).bounds
    return _param_rows(spark, [(c, b[c][0], b[c][1]) for c in NUM])


@register("standard_scaler_lineitem", _params_sql("avg({c})", "stddev_pop({c})"))
def q_standard(spark, sf):
    """F-9: fitted shift (mean) and scale (population std)."""
    p = FE.Scaler(NUM, "standard").fit(lineitem_messy(spark, sf)).affine
    return _param_rows(spark, [(c, p[c][0], p[c][1]) for c in NUM])


@register("robust_scaler_lineitem",
          _params_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def q_robust(spark, sf):
    """F-10: fitted centre (median) and scale (IQR)."""
    p = FE.Scaler(NUM, "robust").fit(lineitem_messy(spark, sf)).affine
    return _param_rows(spark, [(c, p[c][0], p[c][1]) for c in NUM])


@register("minmax_scaled_lineitem", """
WITH li AS (""" + LINEITEM_MESSY_SQL + """), m AS (SELECT min(l_tax) AS lo, max(l_tax) AS hi FROM li)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       R6(CASE WHEN hi > lo THEN (l_tax - lo) / (hi - lo) ELSE l_tax - lo END) AS l_tax
FROM li, m""")
def q_minmax(spark, sf):
    """F-11: rows transformed by the fitted min-max scaler."""
    df = lineitem_messy(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax")
    out = FE.Scaler(["l_tax"], "minmax").fit(df).transform(df)
    return out.withColumn("l_tax", r6(F.col("l_tax")))


@register("ordinal_codes_orders", """
WITH c AS (SELECT o_orderpriority AS v, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS code
           FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL) d)
SELECT o.o_orderkey, coalesce(c.code, -1.0) AS code FROM orders o LEFT JOIN c ON o.o_orderpriority = c.v""")
def q_ordinal(spark, sf):
    """F-14: sorted-category ordinal codes (unseen -> -1)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    out = FE.OrdinalEncode(["o_orderpriority"]).fit(o).transform(o)
    return out.select("o_orderkey", F.col("o_orderpriority__enc").alias("code"))


@register("onehot_counts_orders", """
SELECT o_orderstatus AS category, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus""")
def q_onehot(spark, sf):
    """F-12: one-hot vectors; rows per hot slot, mapped back to the category name."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    m = FE.OneHotEncode(["o_orderstatus"]).fit(o)
    arr = m.transform(o).select(vector_to_array("o_orderstatus__enc").alias("v"))
    slots = arr.select((F.array_position(F.col("v"), 1.0) - 1).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    names = m.tables["o_orderstatus"]
    return slots.join(names, F.col("slot") == F.col("__code")).select(F.col("__v").alias("category"), "n")


@register("class_weights_documents", """
WITH t AS (SELECT l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT quality, count(*) AS n FROM t GROUP BY quality)
SELECT CAST(quality AS DOUBLE) AS label, R6((SELECT count(*) FROM t) * 1.0 / ((SELECT count(*) FROM c) * n)) AS weight FROM c""")
def q_class_weights(spark, sf):
    """F-16: balanced class weights n / (k * n_c)."""
    d = docs_train(spark, sf).select(F.col("quality").cast("double").alias("label"))
    w = FE.class_weight_column(d).select("label", "weight").distinct()
    return w.select("label", r6(F.col("weight")).alias("weight"))


@register("target_encoding_documents", """
WITH t AS (SELECT d.source, CAST(l.quality AS DOUBLE) AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
p AS (SELECT avg(y) AS prior FROM t)
SELECT source, R6((sum(y) + 10.0 * prior) / (count(*) + 10.0)) AS encoding FROM t, p GROUP BY source, prior""")
def q_target_encoding(spark, sf):
    """F-13: smoothed per-category target means (m = 10)."""
    d = docs_train(spark, sf).select("source", F.col("quality").cast("double").alias("label"))
    m = FE.TargetEncode(["source"], "label").fit(d)
    return m.tables["source"].select(F.col("__v").alias("source"), r6(F.col("__te0")).alias("encoding"))


@register("target_encoded_rows_documents", """
WITH t AS (SELECT d.source, CAST(l.quality AS DOUBLE) AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
p AS (SELECT avg(y) AS prior FROM t),
e AS (SELECT source, (sum(y) + 10.0 * prior) / (count(*) + 10.0) AS enc FROM t, p GROUP BY source, prior)
SELECT d.doc_id, R6(coalesce(e.enc, (SELECT prior FROM p))) AS encoding FROM documents d LEFT JOIN e ON d.source = e.source""")
def q_target_encoded_rows(spark, sf):
    """F-13: the fitted encoding on every document, labelled or not; unseen sources get the prior."""
    train = docs_train(spark, sf).select("source", F.col("quality").cast("double").alias("label"))
    m = FE.TargetEncode(["source"], "label").fit(train)
    rows = m.transform(table(spark, sf, "documents").select("doc_id", "source"))
    return rows.select("doc_id", r6(F.col("source__te0")).alias("encoding"))


_CROSS_SQL = """
WITH t AS (SELECT d.doc_id, d.source, CAST(l.quality AS DOUBLE) AS y,
           CAST(('0x' || substr(md5(concat_ws('|', '42', 'cross', coalesce(CAST(d.doc_id AS VARCHAR), '␀'))), 1, 8)) AS BIGINT) % 5 AS j
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
a AS (SELECT x.doc_id, x.source,
             (SELECT avg(y) FROM t o WHERE o.j <> x.j) AS prior,
             (SELECT coalesce(sum(y), 0) FROM t o WHERE o.j <> x.j AND o.source = x.source) AS s,
             (SELECT count(*) FROM t o WHERE o.j <> x.j AND o.source = x.source) AS n
      FROM t x)
SELECT doc_id, R6((s + 10.0 * prior) / (n + 10.0)) AS encoding FROM a"""


@register("target_cross_fitted_documents", _CROSS_SQL)
def q_target_cross_fitted(spark, sf):
    """F-13: every training row encoded from the other inner folds; its own label never enters."""
    train = docs_train(spark, sf).select("doc_id", "source", F.col("quality").cast("double").alias("label"))
    train = cross_folds(train, ["doc_id"])
    rows = FE.TargetEncode(["source"], "label").fit(train).transform(train)
    return rows.select("doc_id", r6(F.col("source__te0")).alias("encoding"))


@register("factorize_part", """
WITH c AS (SELECT p_type AS v, CAST(row_number() OVER (ORDER BY p_type) - 1 AS DOUBLE) AS code
           FROM (SELECT DISTINCT p_type FROM part) d)
SELECT p.p_partkey, coalesce(c.code, -1.0) AS p_type FROM part p LEFT JOIN c ON p.p_type = c.v""")
def q_factorize(spark, sf):
    """F-15: dense value-order codes for strings (NULL -> -1)."""
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    return FE.factorize(p, ["p_type"])


@register("knn_imputed_lineitem")
def q_knn(spark, sf):
    """F-4: k-NN imputation of the missing quantities (exact box descent; SQL twin in ``knn_imputed_gaps_customer``)."""
    df = lineitem_messy(spark, sf).select(*LI_KEY[:2], "l_extendedprice", "l_discount", "l_quantity")
    return FE_knn(df)


GAPS = {
    "a": "CASE WHEN c_custkey % 5 <> 0 THEN sqrt(c_acctbal + 1000) END",
    "b": "CASE WHEN c_custkey % 7 <> 1 THEN sqrt(c_custkey * 7919 % 10007 + 0.5) END",
    "c": "CASE WHEN c_custkey % 3 <> 0 THEN sqrt(c_custkey * 104729 % 100003 + 0.25) END",
}


def _gaps_sql():
    cols = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in GAPS.items())
    total = " + ".join(f"coalesce((r.{c} - d.{c}) * (r.{c} - d.{c}), 0)" for c in GAPS)
    shared = " + ".join(f"CASE WHEN r.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in GAPS)
    fills = ", ".join(
        f"f_{c} AS (SELECT id, avg(v) AS v FROM (SELECT r.id, d.{c} AS v, row_number() OVER (PARTITION BY r.id "
        f"ORDER BY sqrt(({total}) * 3 / ({shared})), d.id) AS rank FROM t r JOIN t d ON r.{c} IS NULL AND d.{c} IS NOT NULL "
        f"AND ({shared}) > 0) WHERE rank <= 5 GROUP BY id)" for c in GAPS)
    out = ", ".join(f"R6(coalesce(t.{c}, f_{c}.v, (SELECT avg({c}) FROM t))) AS {c}" for c in GAPS)
    joins = " ".join(f"LEFT JOIN f_{c} ON f_{c}.id = t.id" for c in GAPS)
    return f"WITH t AS (SELECT c_custkey AS id, {cols} FROM customer), {fills} SELECT t.id AS c_custkey, {out} FROM t {joins}"


@register("knn_imputed_gaps_customer", _gaps_sql())
def q_knn_gaps(spark, sf):
    """F-4: k-NN imputation of a table with gaps in every column, rows without any value included."""
    from quarry.operators.neighbors import KnnImpute

    df = table(spark, sf, "customer").select("c_custkey", *[F.expr(e).cast("double").alias(c) for c, e in GAPS.items()])
    out = KnnImpute(list(GAPS)).fit(df).transform(df)
    return out.select("c_custkey", *[r6(F.col(c)).alias(c) for c in GAPS])


def FE_knn(df):
    from quarry.operators.neighbors import KnnImpute

    cols = ["l_extendedprice", "l_discount", "l_quantity"]
    return KnnImpute(cols).fit(df).transform(df)
