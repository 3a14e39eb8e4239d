"""Checks for preparation (P-*, D-1, A-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.prep import (
    INF_PATTERN,
    NUMBER_PATTERN,
    complete_numeric_cases,
    drop_duplicate_rows,
    nonconstant_columns,
    prepare,
    preview,
)
from quarry.registry import r6, register, table

# lineitem plus a re-appended slice (duplicates), numbers stored as text
# (one column 96 % parseable, one ~75 %), a constant, a constant-with-nulls,
# an all-null column and a target with one rare class.
PREP_SQL = """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount,
       CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE ' ' || CAST(l_extendedprice AS VARCHAR) END AS price_text,
       CASE WHEN l_linenumber = 1 THEN 'unknown' ELSE CAST(l_tax AS VARCHAR) END AS tax_text,
       'fixed' AS constant_col,
       CASE WHEN l_orderkey % 2 = 0 THEN 'k' END AS sparse_constant,
       CAST(NULL AS DOUBLE) AS empty_col,
       CASE WHEN l_orderkey = 1 THEN 'Z' ELSE l_returnflag END AS flag
FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1) s
"""


def prep_input(spark, sf):
    li = table(spark, sf, "lineitem")
    s = li.unionByName(li.where(F.col("l_linenumber") == 1))
    return s.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount",
        F.when(F.col("l_linenumber") == 7, F.lit("n/a"))
        .otherwise(F.concat(F.lit(" "), F.col("l_extendedprice").cast("string"))).alias("price_text"),
        F.when(F.col("l_linenumber") == 1, F.lit("unknown")).otherwise(F.col("l_tax").cast("string")).alias("tax_text"),
        F.lit("fixed").alias("constant_col"),
        F.when(F.col("l_orderkey") % 2 == 0, F.lit("k")).alias("sparse_constant"),
        F.lit(None).cast("double").alias("empty_col"),
        F.when(F.col("l_orderkey") == 1, F.lit("Z")).otherwise(F.col("l_returnflag")).alias("flag"),
    )


def _parse_sql(c):
    return (
        f"CASE WHEN regexp_matches({c}, '{NUMBER_PATTERN}') THEN TRY_CAST(trim({c}) AS DOUBLE) "
        f"WHEN regexp_matches(lower({c}), '{INF_PATTERN}') THEN "
        f"CASE WHEN starts_with(trim({c}), '-') THEN CAST('-inf' AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END END"
    )


PREP_REPORT_SQL = f"""
WITH t AS ({PREP_SQL}),
sh AS (SELECT count(*) AS n,
              count({_parse_sql('price_text')}) / count(price_text) AS s_price,
              count({_parse_sql('tax_text')}) / count(tax_text) AS s_tax,
              count({_parse_sql('constant_col')}) / count(constant_col) AS s_const,
              count({_parse_sql('sparse_constant')}) / count(sparse_constant) AS s_sparse
       FROM t),
c AS (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_discount,
             CASE WHEN (SELECT s_price FROM sh) >= 0.8 THEN CAST({_parse_sql('price_text')} AS VARCHAR) ELSE price_text END AS price_text,
             CASE WHEN (SELECT s_tax FROM sh) >= 0.8 THEN CAST({_parse_sql('tax_text')} AS VARCHAR) ELSE tax_text END AS tax_text,
             constant_col, sparse_constant, empty_col, flag FROM t),
st AS (SELECT count(*) AS n2,
              count(DISTINCT l_orderkey) AS d1, count(DISTINCT l_linenumber) AS d2, count(DISTINCT l_quantity) AS d3,
              count(DISTINCT l_discount) AS d4, count(DISTINCT price_text) AS d5, count(DISTINCT tax_text) AS d6,
              count(DISTINCT constant_col) AS d7, count(DISTINCT sparse_constant) AS d8, count(DISTINCT empty_col) AS d9,
              1 - count(empty_col) / count(*) AS m9, 1 - count(sparse_constant) / count(*) AS m8
       FROM c),
rc AS (SELECT string_agg(flag, ',' ORDER BY flag) AS rare FROM (SELECT flag, count(*) AS k FROM c GROUP BY flag) g WHERE k < 5)
SELECT CAST(sh.n AS BIGINT) AS rows_before, CAST(st.n2 AS BIGINT) AS rows_after,
       CAST(sh.n - st.n2 AS BIGINT) AS dropped_duplicate_rows,
       concat_ws(',', CASE WHEN s_price >= 0.8 THEN 'price_text' END, CASE WHEN s_tax >= 0.8 THEN 'tax_text' END) AS coerced_columns,
       concat_ws(',', CASE WHEN m9 > 0.99 THEN 'empty_col' END) AS dropped_all_nan,
       concat_ws(',', CASE WHEN d1 <= 1 THEN 'l_orderkey' END, CASE WHEN d2 <= 1 THEN 'l_linenumber' END,
                 CASE WHEN d3 <= 1 THEN 'l_quantity' END, CASE WHEN d4 <= 1 THEN 'l_discount' END,
                 CASE WHEN d5 <= 1 THEN 'price_text' END, CASE WHEN d6 <= 1 THEN 'tax_text' END,
                 CASE WHEN d7 <= 1 THEN 'constant_col' END, CASE WHEN d8 <= 1 AND m8 <= 0.99 THEN 'sparse_constant' END) AS dropped_constant,
       coalesce(rc.rare, '') AS rare_classes,
       CAST(10 - (CASE WHEN m9 > 0.99 THEN 1 ELSE 0 END) - (CASE WHEN d7 <= 1 THEN 1 ELSE 0 END) - (CASE WHEN d8 <= 1 THEN 1 ELSE 0 END) AS INTEGER) AS cols_after
FROM sh, st, rc
"""


@register("prepare_report_lineitem", PREP_REPORT_SQL)
def q_prepare_report(spark, sf):
    """P-5..P-9, D-1, A-11: what preparation changed."""
    _, rep = prepare(prep_input(spark, sf), target="flag")
    df = rep.to_frame(spark)
    return df.select(
        "rows_before", "rows_after", "dropped_duplicate_rows",
        F.concat_ws(",", "coerced_columns").alias("coerced_columns"),
        F.concat_ws(",", "dropped_all_nan").alias("dropped_all_nan"),
        F.concat_ws(",", "dropped_constant").alias("dropped_constant"),
        F.concat_ws(",", "rare_classes").alias("rare_classes"),
        "cols_after",
    )


@register(
    "prepared_rows_lineitem",
    f"""
WITH t AS ({PREP_SQL})
SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_discount,
       R6({_parse_sql('price_text')}) AS price_text, tax_text, flag
FROM t""",
)
def q_prepared_rows(spark, sf):
    """P-8 output rows: coerced, de-duplicated, empty/constant columns removed."""
    out, _ = prepare(prep_input(spark, sf), target="flag")
    return out.withColumn("price_text", r6(F.col("price_text")))


@register(
    "dedup_lineitem_slice",
    """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_orders
FROM (SELECT DISTINCT * FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber <= 2) u) d""",
)
def q_dedup(spark, sf):
    """D-1: exact duplicate rows removed across all columns."""
    li = table(spark, sf, "lineitem")
    d = drop_duplicate_rows(li.unionByName(li.where(F.col("l_linenumber") <= 2)))
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_orderkey").alias("n_orders"))


@register(
    "complete_cases_events",
    """
WITH e AS (SELECT CASE WHEN event_type = 'click' THEN NULL ELSE value END AS value,
                  CAST(user_id AS DOUBLE) AS user_id,
                  CASE WHEN event_id % 50 = 0 THEN CAST('inf' AS DOUBLE) ELSE value * 2 END AS twice
           FROM events),
c AS (SELECT * FROM e WHERE value IS NOT NULL AND user_id IS NOT NULL AND twice IS NOT NULL AND abs(twice) < CAST('inf' AS DOUBLE))
SELECT CAST(count(*) AS BIGINT) AS n_complete, R6(sum(value)) AS sum_value,
       concat_ws(',', CASE WHEN stddev_samp(value) > 0 THEN 'value' END, CASE WHEN stddev_samp(user_id) > 0 THEN 'user_id' END,
                 CASE WHEN stddev_samp(twice) > 0 THEN 'twice' END) AS varying
FROM c""",
)
def q_complete_cases(spark, sf):
    """P-3 + P-4: numeric complete cases (inf counts as missing), then non-constant columns."""
    ev = table(spark, sf, "events").select(
        F.when(F.col("event_type") == "click", F.lit(None)).otherwise(F.col("value")).alias("value"),
        F.col("user_id").cast("double").alias("user_id"),
        F.when(F.col("event_id") % 50 == 0, F.lit(float("inf"))).otherwise(F.col("value") * 2).alias("twice"),
    )
    cc = complete_numeric_cases(ev, ["value", "user_id", "twice"])
    keep = nonconstant_columns(cc, ["value", "user_id", "twice"])
    return cc.agg(
        F.count(F.lit(1)).alias("n_complete"),
        r6(F.sum("value")).alias("sum_value"),
    ).withColumn("varying", F.lit(",".join(keep)))


@register(
    "preview_orders",
    "SELECT o_orderkey, o_custkey, o_orderstatus, R6(o_totalprice) AS o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10",
)
def q_preview(spark, sf):
    """P-10: first ten rows by key (a top-k report)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return preview(o, ["o_orderkey"]).withColumn("o_totalprice", r6(F.col("o_totalprice")))
