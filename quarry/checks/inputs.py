"""Derived inputs shared by the checks, stated once for Spark and once as SQL.

The driver tables are clean (no nulls, no duplicates), so the messy shapes the
operators must handle are derived by the same expressions in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.registry import table

# lineitem with 1/3 missing quantities, a block of tax outliers, an
# identifier-like string column and a leakage column (net price).
LINEITEM_MESSY_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
       l_extendedprice, l_discount,
       CASE WHEN l_linenumber = 7 THEN l_tax * 100 ELSE l_tax END AS l_tax,
       l_returnflag, l_linestatus,
       CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS l_line_id,
       l_extendedprice * (1 - l_discount) AS l_netprice
FROM lineitem
"""


def lineitem_messy(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_orderkey") % 3 != 0, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount",
        F.when(F.col("l_linenumber") == 7, F.col("l_tax") * 100).otherwise(F.col("l_tax")).alias("l_tax"),
        "l_returnflag", "l_linestatus",
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("l_line_id"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("l_netprice"),
    )


# documents with their (partial) quality labels: ~60 % missing target.
DOCS_LABELLED_SQL = """
SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, l.quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def docs_labelled(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").select("doc_id", "lang", "source", "n_chars", "text", "quality")


# labelled documents only, for supervised runs (quality is the target).
DOCS_TRAIN_SQL = """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.toxic, l.quality
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""


def docs_train(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels")
    return d.join(lab, "doc_id").select("doc_id", "lang", "source", "n_chars", "toxic", "quality")
