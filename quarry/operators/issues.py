"""Data-quality issue detectors (I-1 .. I-9).

Data passes: the profile (see ``operators.profile``) plus **one** extra
aggregation that counts Tukey outliers for every numeric column and computes
the guarded Pearson r of every numeric feature against a regression target.
Quartiles come from the profile and are injected as literals, so nothing is
recomputed.  The detectors themselves are rules over at most one row per
column, evaluated on the driver and returned as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.nulls import nan_to_null
from quarry.functions.stats import pearson_expr
from quarry.operators.profile import Profile, profile as build_profile

# Detector thresholds (inclusive >= unless noted).
MISSING_HIGH = 0.30
MISSING_MEDIUM = 0.10
MISSING_LOW = 0.01
OUTLIER_HIGH = 0.05
OUTLIER_MEDIUM = 0.02
DUPLICATE_HIGH = 0.01
DUPLICATE_MEDIUM = 0.001
IMBALANCE_HIGH = 0.10  # minority share <= this
IMBALANCE_MEDIUM = 0.20  # minority share <= this
LEAKAGE_HIGH = 0.95
LEAKAGE_MEDIUM = 0.90
HIGH_CARDINALITY_RATIO = 0.50
TUKEY_FACTOR = 1.5
MIN_CORRELATION_PAIRS = 10
QUESTION_MISSING_RATE = 0.40  # strictly greater
MAX_QUESTIONS = 4

SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}
DETECTOR_ORDER = {
    "high_missingness": 0,
    "outliers": 1,
    "duplicates": 2,
    "noisy_categories": 3,
    "leakage_candidate": 4,
    "class_imbalance": 5,
}

ISSUE_SCHEMA = (
    "issue_type string, severity string, severity_rank int, affected_column string, "
    "description string, evidence map<string,double>, minority_class string, "
    "detector_ord int, column_ord int, position int"
)


def _q(name: str):
    return F.col(f"`{name}`")


def tukey_bounds(q1: float, q3: float, factor: float = TUKEY_FACTOR) -> tuple[float, float]:
    iqr = q3 - q1
    return q1 - factor * iqr, q3 + factor * iqr


def second_pass(df: DataFrame, prof: Profile) -> dict:
    """One aggregation: outlier counts (I-2) and target correlations (I-5)."""
    exprs = []
    outlier_cols = []
    for r in prof.columns:
        if r["dtype"] != "numeric" or r["q1"] is None or r["q3"] is None:
            continue
        if r["q3"] - r["q1"] == 0:
            continue
        lo, hi = tukey_bounds(r["q1"], r["q3"])
        x = nan_to_null(_q(r["column"]), df.schema[r["column"]].dataType).cast("double")
        i = r["ordinal"]
        exprs.append(F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias(f"o{i}"))
        outlier_cols.append((r, lo, hi))
    corr_cols = []
    if prof.target is not None and prof.target_type == "regression":
        y = nan_to_null(_q(prof.target), df.schema[prof.target].dataType).cast("double")
        for r in prof.columns:
            if r["column"] == prof.target or r["dtype"] != "numeric":
                continue
            x = nan_to_null(_q(r["column"]), df.schema[r["column"]].dataType).cast("double")
            i = r["ordinal"]
            exprs += [
                pearson_expr(x, y).alias(f"r{i}"),
                F.count_if(x.isNotNull() & y.isNotNull()).alias(f"p{i}"),
            ]
            corr_cols.append(r)
    row = df.agg(*exprs).first() if exprs else None
    out = {"outliers": [], "corr": []}
    for r, lo, hi in outlier_cols:
        out["outliers"].append((r, lo, hi, int(row[f"o{r['ordinal']}"])))
    for r in corr_cols:
        out["corr"].append((r, row[f"r{r['ordinal']}"], int(row[f"p{r['ordinal']}"])))
    return out


def _issue(kind, sev, col, ordn, desc, evidence, minority=None):
    return (
        kind,
        sev,
        SEVERITY_RANK[sev],
        col,
        desc,
        {k: float(v) for k, v in evidence.items()},
        minority,
        DETECTOR_ORDER[kind],
        ordn,
    )


def issue_rows(prof: Profile, passes: dict) -> list[tuple]:
    rows = []
    # I-1 missingness, target included
    for r in prof.columns:
        m = r["missing_rate"] or 0.0
        sev = "high" if m >= MISSING_HIGH else "medium" if m >= MISSING_MEDIUM else "low" if m >= MISSING_LOW else None
        if sev:
            rows.append(_issue("high_missingness", sev, r["column"], r["ordinal"],
                               f"{r['column']}: {m:.1%} of values are missing", {"missing_rate": m}))
    # I-2 Tukey outliers, rate over non-null values
    for r, lo, hi, n_out in passes["outliers"]:
        non_null = r["n_rows"] - r["n_missing"]
        rate = n_out / max(non_null, 1)
        sev = "high" if rate >= OUTLIER_HIGH else "medium" if rate >= OUTLIER_MEDIUM else None
        if sev:
            rows.append(_issue("outliers", sev, r["column"], r["ordinal"],
                               f"{r['column']}: {rate:.1%} of values fall outside the 1.5 IQR fence",
                               {"outlier_rate": rate, "n_outliers": n_out, "lower_bound": lo, "upper_bound": hi}))
    # I-3 duplicates (table level)
    dr = prof.duplicate_rate
    sev = "high" if dr >= DUPLICATE_HIGH else "medium" if dr >= DUPLICATE_MEDIUM else None
    if sev:
        rows.append(_issue("duplicates", sev, None, -1,
                           f"{prof.n_duplicates} rows repeat an earlier row ({dr:.1%})",
                           {"n_duplicates": prof.n_duplicates, "duplicate_rate": dr}))
    # I-4 identifier-like categoricals, always medium
    for r in prof.columns:
        if r["dtype"] != "categorical" or r["column"] == prof.target:
            continue
        ratio = r["n_unique"] / max(prof.n_rows, 1)
        if ratio >= HIGH_CARDINALITY_RATIO:
            rows.append(_issue("noisy_categories", "medium", r["column"], r["ordinal"],
                               f"{r['column']}: {r['n_unique']} distinct values ({ratio:.1%} of rows), "
                               "looks like an identifier or free text",
                               {"n_unique": r["n_unique"], "cardinality_ratio": ratio}))
    # I-5 leakage, regression targets only
    for r, corr, pairs in passes["corr"]:
        if pairs < MIN_CORRELATION_PAIRS or corr is None:
            continue
        a = abs(corr)
        sev = "high" if a >= LEAKAGE_HIGH else "medium" if a >= LEAKAGE_MEDIUM else None
        if sev:
            rows.append(_issue("leakage_candidate", sev, r["column"], r["ordinal"],
                               f"{r['column']}: |r| = {a:.3f} against the target, check it is known before the outcome",
                               {"correlation": a}))
    # I-6 class imbalance
    if prof.target_type != "regression" and prof.class_distribution:
        cls, share = min(prof.class_distribution.items(), key=lambda kv: (kv[1], kv[0]))
        sev = "high" if share <= IMBALANCE_HIGH else "medium" if share <= IMBALANCE_MEDIUM else None
        if sev:
            tord = prof.by_name[prof.target]["ordinal"]
            rows.append(_issue("class_imbalance", sev, prof.target, tord,
                               f"minority class '{cls}' holds {share:.1%} of rows",
                               {"minority_rate": share}, minority=cls))
    # I-7 stable sort: severity, then detector order, then column order
    rows.sort(key=lambda t: (t[2], t[7], t[8]))
    return [t + (i + 1,) for i, t in enumerate(rows)]


def detect_issues(df: DataFrame, target: str | None = None, prof: Profile | None = None) -> DataFrame:
    """I-1..I-7: issues DataFrame sorted high -> low (``ISSUE_SCHEMA``)."""
    if prof is None:
        prof = build_profile(df, target)
    rows = issue_rows(prof, second_pass(df, prof))
    spark = df.sparkSession
    return spark.createDataFrame(rows, ISSUE_SCHEMA)


def issue_counts(issues: DataFrame) -> DataFrame:
    """I-9: issue counts by severity (all three severities present)."""
    sev = issues.sparkSession.createDataFrame([(s, r) for s, r in SEVERITY_RANK.items()], "severity string, severity_rank int")
    counts = issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n_issues"))
    return (
        sev.join(counts, "severity", "left")
        .select("severity", "severity_rank", F.coalesce("n_issues", F.lit(0)).cast("long").alias("n_issues"))
        .orderBy("severity_rank")
    )


# Question wording is ours; the selection rules are the spec (I-8).
GENERIC_QUESTIONS = {
    "leakage_candidate": (
        "'{column}' tracks the target '{target}' almost exactly (|r| = {value:.3f}). "
        "Is it measured before the outcome you want to predict? If it is only known "
        "afterwards it should be left out of the model."
    ),
    "noisy_categories": (
        "'{column}' has {value:.0f} distinct values. Should they be grouped into broader "
        "categories, or is this an identifier that should be excluded?"
    ),
    "high_missingness": (
        "'{column}' is missing in {value:.1%} of rows. Does a missing value mean 'did not "
        "happen / not applicable', or was the value simply not recorded?"
    ),
}


def clarification_questions(issues: DataFrame, target: str | None = None, domain_question: str | None = None,
                            column_questions: DataFrame | None = None, limit: int = MAX_QUESTIONS) -> DataFrame:
    """I-8: questions for HIGH issues needing domain knowledge, at most ``limit``.

    Eligible: leakage candidates, noisy categories and missingness above 40 %.
    Noisy categories are only ever MEDIUM (I-4), so that branch never fires;
    the filter is kept literally.  ``column_questions`` (issue_type, column,
    question) supplies domain wording that wins over the generic template;
    ``domain_question`` is asked first when the domain is ambiguous.
    """
    spark = issues.sparkSession
    value = (
        F.when(F.col("issue_type") == "leakage_candidate", F.col("evidence")["correlation"])
        .when(F.col("issue_type") == "noisy_categories", F.col("evidence")["n_unique"])
        .otherwise(F.col("evidence")["missing_rate"])
    )
    eligible = issues.where(
        (F.col("severity") == "high")
        & F.col("affected_column").isNotNull()
        & (
            F.col("issue_type").isin("leakage_candidate", "noisy_categories")
            | ((F.col("issue_type") == "high_missingness") & (F.col("evidence")["missing_rate"] > QUESTION_MISSING_RATE))
        )
    ).withColumn("value", value)
    generic = F.lit(None).cast("string")
    for kind, tpl in GENERIC_QUESTIONS.items():
        # render with format_string: positions %1$s column, %2$s target, %3$s value
        fmt = (
            tpl.replace("{column}", "%1$s")
            .replace("{target}", "%2$s")
            .replace("{value:.3f}", "%3$.3f")
            .replace("{value:.0f}", "%3$.0f")
            .replace("{value:.1%}", "%4$.1f%%")
        )
        generic = F.when(
            F.col("issue_type") == kind,
            F.format_string(fmt, F.col("affected_column"), F.lit(target or "target"), F.col("value"), F.col("value") * 100),
        ).otherwise(generic)
    q = eligible.withColumn("generic", generic)
    if column_questions is not None:
        q = q.join(
            column_questions.select(
                F.col("issue_type").alias("issue_type"),
                F.col("column").alias("affected_column"),
                F.col("question").alias("domain_q"),
            ),
            ["issue_type", "affected_column"],
            "left",
        )
    else:
        q = q.withColumn("domain_q", F.lit(None).cast("string"))
    q = q.select(
        F.coalesce("domain_q", "generic").alias("question"),
        "affected_column",
        "issue_type",
        F.col("position").alias("__o"),
    )
    if domain_question:
        head = spark.createDataFrame(
            [(domain_question, None, "domain_confirmation", 0)],
            "question string, affected_column string, issue_type string, __o int",
        )
        q = head.unionByName(q)
    # the cap of four questions is the feature; HIGH issues are bounded by the column count
    top = q.orderBy("__o").limit(limit).collect()
    rows = [
        (r["question"], r["affected_column"], r["issue_type"], i + 1)
        for i, r in enumerate(top)
    ]
    out = spark.createDataFrame(rows, "question string, affected_column string, issue_type string, position int")
    return (
        out.withColumn("question_id", F.substring(F.md5(F.concat_ws("|", "issue_type", F.coalesce("affected_column", F.lit("")))), 1, 8))
        .withColumn("answer", F.lit(None).cast("string"))
        .select("question_id", "question", "affected_column", "issue_type", "answer", "position")
    )
