"""Checks for vocabulary tagging and goal routing (V-*, G-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import vocab_data as V
from quarry.operators.goals import (
    EXPLORATORY_PATTERNS,
    LEADING_VERB,
    PREDICTIVE_PATTERNS,
    TRAILING_CLAUSE,
    mode_expr,
    route_goals,
    target_phrase,
)
from quarry.operators.profile import top_values, value_counts_long
from quarry.operators.vocab import (
    AMBIGUOUS_THRESHOLD,
    DOMAIN_THRESHOLD,
    VALUE_TOP_N,
    catalog_of,
    group_pattern,
    groups,
    table_domain,
    tag_columns,
)
from quarry.registry import TABLES, r6, register, table
from quarry.functions.dtypes import logical_dtype
from pyspark.sql import types as T


def _tables(spark, sf):
    return {t: table(spark, sf, t) for t in TABLES}


def top_string_values(tables: dict) -> "DataFrame":
    """(table_name, column_name, value): 15 most frequent values of every string column."""
    parts = []
    for name, df in tables.items():
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        if not cols:
            continue
        sub = df.select(*cols)
        tv = top_values(value_counts_long(sub), VALUE_TOP_N)
        names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cols)], "ordinal int, column_name string")
        parts.append(tv.join(F.broadcast(names), "ordinal").select(F.lit(name).alias("table_name"), "column_name", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _norm_sql(c: str) -> str:
    s = f"regexp_replace({c}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    s = f"lower({s})"
    s = f"regexp_replace({s}, '[_\\-]+', ' ', 'g')"
    s = f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.ABBREVIATIONS.items())
    return f"array_to_string(list_transform(string_split({s}, ' '), lambda t: CASE t {cases} ELSE t END), ' ')"


def _exact_sql(n: str) -> str:
    cat = " ".join(f"WHEN regexp_matches({n}, '{group_pattern(a)}') THEN '{c}'" for c, k, a in groups())
    can = " ".join(f"WHEN regexp_matches({n}, '{group_pattern(a)}') THEN '{k}'" for c, k, a in groups())
    return f"CASE {cat} END", f"CASE {can} END"


def _string_columns_sql(spark_schemas: dict) -> str:
    parts = []
    for t, fields in spark_schemas.items():
        for c in fields:
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {t}")
    return " UNION ALL ".join(parts)


# string columns of the driver tables (fixed by the table layout in TESTDATA.md)
STRING_COLUMNS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"],
    "conversations": ["role", "text"],
}


def _tags_sql() -> str:
    ecat, ecan = _exact_sql("n")
    terms = ", ".join(f"'{t}'" for t in V.VALUE_TERMS)
    tlist = ", ".join(f"'{t}'" for t in TABLES)
    return f"""
WITH cat AS (SELECT table_name, column_name, CAST(ordinal_position - 1 AS INTEGER) AS ordinal
             FROM information_schema.columns WHERE table_name IN ({tlist})),
nn AS (SELECT *, {_norm_sql('column_name')} AS n FROM cat),
ex AS (SELECT *, {ecat} AS ecat, {ecan} AS ecan FROM nn),
u AS ({_string_columns_sql(STRING_COLUMNS)}),
c AS (SELECT table_name, column_name, value, count(*) AS k FROM u WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY k DESC, value) AS rk FROM c),
vm AS (SELECT DISTINCT table_name, column_name FROM r
       WHERE rk <= {VALUE_TOP_N} AND len(list_filter([{terms}], lambda x: contains(lower(trim(value)), x))) > 0),
j AS (SELECT ex.*, vm.column_name IS NOT NULL AS vhit FROM ex LEFT JOIN vm USING (table_name, column_name))
SELECT table_name, column_name, ordinal,
       CASE WHEN ecat IS NOT NULL THEN ecat WHEN vhit THEN 'entity' END AS category,
       CASE WHEN ecat IS NOT NULL THEN ecan WHEN vhit THEN 'player' END AS canonical,
       CASE WHEN ecat IS NOT NULL THEN 'exact' WHEN vhit THEN 'value' END AS match_kind,
       CAST(CASE WHEN ecat IS NOT NULL THEN 1.0 WHEN vhit THEN 0.5 ELSE 0.0 END AS DOUBLE) AS weight
FROM j"""


@register("column_tags_catalog", _tags_sql())
def q_column_tags(spark, sf):
    """V-1..V-3, V-5: exact name tags and value-scan tags for every column of every table."""
    tabs = _tables(spark, sf)
    tags = tag_columns(catalog_of(tabs), top_string_values(tabs), fuzzy=False)
    return tags.select("table_name", "column_name", "ordinal", "category", "canonical", "match_kind", "weight")


@register(
    "table_domains_catalog",
    f"""WITH t AS ({_tags_sql()})
SELECT table_name, R6(sum(weight) / count(*)) AS confidence, CAST(count(*) AS BIGINT) AS n_columns,
       CASE WHEN sum(weight) / count(*) >= {DOMAIN_THRESHOLD} THEN 'sports'
            WHEN sum(weight) / count(*) >= {AMBIGUOUS_THRESHOLD} THEN 'possible_sports' ELSE 'general_tabular' END AS detected_domain
FROM t GROUP BY table_name""",
)
def q_table_domains(spark, sf):
    """V-6, V-7: per-table confidence and domain class (exact + value parts)."""
    tabs = _tables(spark, sf)
    d = table_domain(tag_columns(catalog_of(tabs), top_string_values(tabs), fuzzy=False))
    return d.select("table_name", r6(F.col("confidence")).alias("confidence"), "n_columns", "detected_domain")


@register("column_tags_fuzzy_catalog")
def q_column_tags_fuzzy(spark, sf):
    """V-4: full tagging including the Ratcliff-Obershelp fuzzy pass (no SQL twin)."""
    tabs = _tables(spark, sf)
    return tag_columns(catalog_of(tabs), top_string_values(tabs), fuzzy=True)


def _rx(patterns):
    return "(" + ")|(".join(patterns) + ")"


@register(
    "goal_modes_conversations",
    f"""SELECT conv_id, turn,
  CASE WHEN regexp_matches(lower(text), '{_rx(EXPLORATORY_PATTERNS)}') AND NOT regexp_matches(lower(text), '{_rx(PREDICTIVE_PATTERNS)}')
       THEN 'exploratory' ELSE 'predictive' END AS mode,
  trim(regexp_replace(trim(regexp_replace(lower(text), '{LEADING_VERB}', '')), '{TRAILING_CLAUSE}', '')) AS target_phrase
FROM conversations""",
)
def q_goal_modes(spark, sf):
    """G-1, G-2: operating mode and target phrase of every user turn."""
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", mode_expr(F.col("text")).alias("mode"), target_phrase(F.col("text")).alias("target_phrase"))


@register("goal_routes_conversations")
def q_goal_routes(spark, sf):
    """G-3..G-7: target column for every user turn against the lineitem columns (fuzzy part: no SQL twin)."""
    c = table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("goal_id"), "text"
    )
    li = table(spark, sf, "lineitem")
    dtypes = {f.name: logical_dtype(f.dataType) for f in li.schema.fields}
    return route_goals(c, li.columns, dtypes)
