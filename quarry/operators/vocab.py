"""Column-domain tagging over a catalog of columns (V-1 .. V-8).

Input is a *catalog* frame ``(table_name, column_name, ordinal)`` so one job
tags the columns of many tables at once, plus optionally the top values of
the string columns (from ``operators.profile.value_counts_long``).

* exact synonym matching is one ordered ``CASE`` of ``rlike`` patterns (one
  pattern per synonym group, category priority first): a projection, no join;
* the fuzzy pass (unmatched columns only) is an Arrow ``pandas_udf`` running
  the Ratcliff-Obershelp ratio against the fixed alias list;
* the value scan checks the 15 most frequent values of each string column for
  domain terms with ``exists`` over a literal term array;
* confidence and domain are a ``groupBy(table)`` aggregation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import best_fuzzy_udf, expand_tokens, normalise_name
from quarry.operators import vocab_data as V

# Fixed values of the tagging rules.
FUZZY_THRESHOLD = 0.75
FUZZY_MIN_ALIAS_LEN = 4
EXACT_WEIGHT = 1.0
SOFT_WEIGHT = 0.5
DOMAIN_THRESHOLD = 0.05
AMBIGUOUS_THRESHOLD = 0.02
VALUE_TOP_N = 15

TAG_SCHEMA = "table_name string, column_name string, ordinal int, normalised string, category string, canonical string, bucket string, match_kind string, weight double"


def group_pattern(aliases: list[str]) -> str:
    """Alias bounded by non-letters; works in Java regex and RE2 (no look-behind)."""
    alts = "|".join(re.escape(a).replace("\\ ", " ") for a in aliases)
    return f"(^|[^a-z])({alts})($|[^a-z])"


def groups() -> list[tuple[str, str, list[str]]]:
    """(category, canonical, aliases) in priority order."""
    return [(cat, canon, aliases) for cat in V.CATEGORY_ORDER for canon, aliases in V.SYNONYMS[cat].items()]


def exact_match(norm: Column) -> Column:
    """V-3: struct(category, canonical) of the first matching group, NULL if none."""
    out = F.lit(None).cast("struct<category:string,canonical:string>")
    for cat, canon, aliases in reversed(groups()):
        out = F.when(norm.rlike(group_pattern(aliases)),
                     F.struct(F.lit(cat).alias("category"), F.lit(canon).alias("canonical"))).otherwise(out)
    return out


def fuzzy_candidates() -> list[tuple[str, str, str]]:
    return [(a, cat, canon) for cat, canon, aliases in groups() for a in aliases if len(a) >= FUZZY_MIN_ALIAS_LEN]


def bucket_expr(cat: Column) -> Column:
    m = F.create_map(*[x for kv in V.CATEGORY_BUCKET.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.element_at(m, cat)


def catalog_of(tables: dict[str, DataFrame]) -> DataFrame:
    """Catalog frame ``(table_name, column_name, ordinal)`` from the tables' schemas."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, f.name, i) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int")


def value_matches(top_values: DataFrame) -> DataFrame:
    """V-5: columns whose top values (lower/trim) contain a domain term.

    ``top_values``: (table_name, column_name, value) already limited to the 15
    most frequent values of each string column.
    """
    terms = F.array(*[F.lit(t) for t in V.VALUE_TERMS])
    hit = F.exists(terms, lambda t: F.instr(F.lower(F.trim(F.col("value"))), t) > 0)
    return top_values.where(hit).select("table_name", "column_name").distinct()


def tag_columns(catalog: DataFrame, top_values: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """V-1..V-5: one row per catalog column with its tag (or NULLs).

    match_kind: 'exact' (weight 1), 'fuzzy' (0.5, unmatched names only),
    'value' (0.5, names unmatched by both; tagged as entity/'player'), or NULL.
    """
    norm = expand_tokens(normalise_name(F.col("column_name")), V.ABBREVIATIONS)
    c = catalog.withColumn("normalised", norm).withColumn("__ex", exact_match(F.col("normalised")))
    if fuzzy:
        best = best_fuzzy_udf(fuzzy_candidates())
        # the UDF only sees names the exact pass left unmatched
        c = c.withColumn("__fz", F.when(F.col("__ex").isNull(), best(F.col("normalised"))))
        fz_ok = F.col("__fz.ratio") >= FUZZY_THRESHOLD
    else:
        c = c.withColumn("__fz", F.lit(None).cast("struct<ratio:double,category:string,canonical:string>"))
        fz_ok = F.lit(False)
    if top_values is not None:
        vm = value_matches(top_values).withColumn("__vm", F.lit(True))
        c = c.join(vm, ["table_name", "column_name"], "left")
    else:
        c = c.withColumn("__vm", F.lit(None).cast("boolean"))
    kind = (
        F.when(F.col("__ex").isNotNull(), F.lit("exact"))
        .when(fz_ok, F.lit("fuzzy"))
        .when(F.col("__vm"), F.lit("value"))
    )
    c = c.withColumn("match_kind", kind)
    cat = (
        F.when(F.col("match_kind") == "exact", F.col("__ex.category"))
        .when(F.col("match_kind") == "fuzzy", F.col("__fz.category"))
        .when(F.col("match_kind") == "value", F.lit("entity"))
    )
    canon = (
        F.when(F.col("match_kind") == "exact", F.col("__ex.canonical"))
        .when(F.col("match_kind") == "fuzzy", F.col("__fz.canonical"))
        .when(F.col("match_kind") == "value", F.lit("player"))
    )
    weight = F.when(F.col("match_kind") == "exact", EXACT_WEIGHT).when(F.col("match_kind").isNotNull(), SOFT_WEIGHT).otherwise(0.0)
    return c.select(
        "table_name", "column_name", "ordinal", "normalised",
        cat.alias("category"), canon.alias("canonical"), bucket_expr(cat).alias("bucket"),
        "match_kind", weight.alias("weight"),
    )


def table_domain(tags: DataFrame, domain: str = "sports") -> DataFrame:
    """V-6: confidence = weighted matches / columns; domain class and flag per table."""
    agg = tags.groupBy("table_name").agg(
        (F.sum("weight") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("confidence"),
        F.count(F.lit(1)).alias("n_columns"),
        F.count("match_kind").alias("n_matched"),
    )
    label = (
        F.when(F.col("confidence") >= DOMAIN_THRESHOLD, F.lit(domain))
        .when(F.col("confidence") >= AMBIGUOUS_THRESHOLD, F.lit(f"possible_{domain}"))
        .otherwise(F.lit("general_tabular"))
    )
    return agg.withColumn("detected_domain", label).withColumn(
        "is_domain", F.col("detected_domain") != "general_tabular"
    )


def is_domain(domains: DataFrame, threshold: float = DOMAIN_THRESHOLD) -> DataFrame:
    """V-7: tables whose confidence reaches ``threshold``."""
    return domains.where(F.col("confidence") >= threshold)


def column_questions(tags: DataFrame) -> DataFrame:
    """V-8: domain wording per (issue_type, column) from the template table.

    Leakage prefers performance then spatial columns, missingness playing-time
    then injury, cardinality entity columns; the first template per
    (issue_type, column) wins.
    """
    spark = tags.sparkSession
    tpl = spark.createDataFrame(
        [(i, t, cat, s) for i, (t, cat, s) in enumerate(V.QUESTION_TEMPLATES)],
        "priority int, issue_type string, category string, template string",
    )
    j = tags.where(F.col("category").isNotNull()).join(F.broadcast(tpl), "category")
    first = j.groupBy("table_name", "issue_type", "column_name").agg(F.min_by("template", "priority").alias("template"))
    return first.select(
        "table_name", "issue_type", F.col("column_name").alias("column"),
        F.replace(F.col("template"), F.lit("{column}"), F.col("column_name")).alias("question"),
    )


def domain_question(domains: DataFrame) -> DataFrame:
    """The confirmation question, only for tables in the ambiguous class."""
    return domains.where(F.col("detected_domain").startswith("possible_")).select(
        "table_name", F.lit(V.DOMAIN_QUESTION).alias("question")
    )
