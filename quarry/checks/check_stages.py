"""Checks for stages and run tables whose result is exact in SQL (C-1, F-1, F-2, F-6, F-8, O-10, O-11, O-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import cluster as CL
from quarry.operators import features as FE
from quarry.plans import compare as CM
from quarry.registry import r6, register, table

SCALED = ["l_quantity", "l_extendedprice", "l_discount"]


def _standardised_sql(c):
    return f"R6((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_pop({c}) OVER ()) AS {c}"


@register("standardised_lineitem",
          "SELECT l_orderkey, l_linenumber, " + ", ".join(_standardised_sql(c) for c in SCALED) + " FROM lineitem")
def q_standardise(spark, sf):
    """C-1: every row, centred and scaled by the population deviation."""
    out = CL.standardise(table(spark, sf, "lineitem"), SCALED)
    return out.select("l_orderkey", "l_linenumber", *[r6(F.col(c)).alias(c) for c in SCALED])


# prices with both infinities and NaN on some line numbers
@register("inf_to_null_lineitem", """
WITH x AS (SELECT l_orderkey, l_linenumber,
    CASE l_linenumber WHEN 7 THEN CAST('Infinity' AS DOUBLE) WHEN 6 THEN CAST('NaN' AS DOUBLE)
         WHEN 5 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST(l_extendedprice AS DOUBLE) END AS price FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN isfinite(price) THEN R6(price) END AS price FROM x
""")
def q_inf_to_null(spark, sf):
    """F-1: infinities and NaN become NULL, all other values stay."""
    ln, inf = F.col("l_linenumber"), float("inf")
    price = F.when(ln == 7, F.lit(inf)).when(ln == 6, F.lit(float("nan"))).when(ln == 5, F.lit(-inf)).otherwise(F.col("l_extendedprice").cast("double"))
    out = FE.InfToNull(["price"]).transform(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", price.alias("price")))
    return out.select("l_orderkey", "l_linenumber", r6(F.col("price")).alias("price"))


KEPT = ["l_quantity", "l_tax", "never", "always_one", "one_or_null", "seldom"]
_KEPT_SQL = """li AS (SELECT l_quantity, l_tax, CASE WHEN l_linenumber < 0 THEN l_tax END AS never, l_linenumber / l_linenumber AS always_one,
    CASE WHEN l_linenumber = 7 THEN 1 END AS one_or_null, CASE WHEN l_linenumber = 7 THEN l_tax END AS seldom FROM lineitem)"""


@register("kept_columns_lineitem", "WITH " + _KEPT_SQL + " " + " UNION ALL ".join(
    f"SELECT 'empty' AS stage, '{c}' AS column_name FROM li HAVING count({c}) > 0 UNION ALL "
    f"SELECT 'constant', '{c}' FROM li HAVING var_pop({c}) > 0" for c in KEPT))
def q_kept_columns(spark, sf):
    """F-2, F-8: columns left after dropping the empty ones, and after dropping the constant ones."""
    ln = F.col("l_linenumber")
    df = table(spark, sf, "lineitem").select(
        "l_quantity", "l_tax", F.when(ln < 0, F.col("l_tax")).alias("never"), (ln / ln).alias("always_one"),
        F.when(ln == 7, 1).alias("one_or_null"), F.when(ln == 7, F.col("l_tax")).alias("seldom"))
    kept = [("empty", c) for c in FE.DropEmpty(KEPT).fit(df).transform(df).columns]
    kept += [("constant", c) for c in FE.DropConstant(KEPT).fit(df).transform(df).columns]
    return spark.createDataFrame(kept, "stage string, column_name string")


@register("most_frequent_orders", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS priority,
                  CASE WHEN o_custkey % 5 <> 0 THEN o_orderstatus END AS status FROM orders)
SELECT o_orderkey,
       coalesce(priority, (SELECT priority FROM o WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS priority,
       coalesce(status, (SELECT status FROM o WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)) AS status
FROM o
""")
def q_most_frequent(spark, sf):
    """F-6: gaps filled with the most frequent value of the column."""
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderstatus")).alias("status"))
    return FE.MostFrequentImpute(["priority", "status"]).fit(df).transform(df)


@register("attempt_history_lineitem", """
SELECT l_linenumber AS iteration, CAST(l_orderkey AS VARCHAR) AS plan_id, l_returnflag AS model,
       CAST(l_extendedprice AS DOUBLE) AS score, CAST(l_tax AS DOUBLE) AS cv_std, CAST(l_quantity AS DOUBLE) AS quantity,
       CASE WHEN l_linenumber <> 7 THEN CAST(l_discount AS DOUBLE) END AS discount
FROM lineitem
""")
def q_attempt_history(spark, sf):
    """O-10: lines as attempts, their metric map as columns; an absent metric is NULL."""
    quantity = [F.lit("quantity"), F.col("l_quantity").cast("double")]
    both = F.create_map(*quantity, F.lit("discount"), F.col("l_discount").cast("double"))
    attempts = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("iteration"), F.col("l_orderkey").cast("string").alias("plan_id"), F.col("l_returnflag").alias("model"),
        F.col("l_extendedprice").cast("double").alias("score"), F.col("l_tax").cast("double").alias("cv_std"),
        F.when(F.col("l_linenumber") == 7, F.create_map(*quantity)).otherwise(both).alias("metric_values"))
    return CM.attempt_history(attempts, ["quantity", "discount"])


@register("best_per_run_orders", """
WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority, CAST(floor(o_totalprice / 50000) AS DOUBLE) AS score,
                  count(*) OVER (PARTITION BY o_custkey) AS n_attempts,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 50000) DESC, o_orderkey) AS place FROM orders)
SELECT o_custkey AS run_id, n_attempts, CAST(o_orderkey AS VARCHAR) AS plan_id, o_orderpriority AS model, score, o_orderkey AS iteration
FROM r WHERE place = 1
""")
def q_best_per_run(spark, sf):
    """O-11: customers as runs; coarse scores, so that ties go to the earliest attempt."""
    log = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").cast("string").alias("plan_id"), F.col("o_orderpriority").alias("model"),
        F.floor(F.col("o_totalprice") / 50000).cast("double").alias("score"), F.col("o_orderkey").alias("iteration"))
    return CM.best_per_run(log)


@register("warm_start_delta_orders", """
WITH s AS (SELECT o_orderstatus AS s, max(CAST(o_totalprice AS DOUBLE)) AS score, count(*) AS n FROM orders GROUP BY 1)
SELECT a.score AS score_1, b.score AS score_2, R6(b.score - a.score) AS score_delta, a.n AS iter_1, b.n AS iter_2, b.n - a.n AS iteration_delta
FROM s a, s b WHERE a.s = 'F' AND b.s = 'O'
""")
def q_warm_start_delta(spark, sf):
    """O-13: two runs' best score and number of attempts, and their differences."""
    runs = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.max(F.col("o_totalprice").cast("double")).alias("score"), F.count(F.lit(1)).alias("n_iterations"))
    out = CM.warm_start_delta(runs.where("o_orderstatus = 'F'"), runs.where("o_orderstatus = 'O'"))
    return out.withColumn("score_delta", r6(F.col("score_delta")))
