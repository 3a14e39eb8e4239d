"""Plan generation: rule plan, search space, seeded sampling, proposals (O-1, O-3 .. O-6).

All of these work on small frames (issues, the option grid, attempt history),
so every step is a plain DataFrame expression; the option grid is produced
by successive ``explode`` calls on a one-row frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.models import CLASSIFIERS, ENCODERS, IMBALANCE, IMPUTERS, OUTLIERS, REGRESSORS, SCALERS

AXES = ["imputation", "outlier_handling", "encoding", "scaling", "model", "imbalance_strategy"]
REQUIRED_FIELDS = AXES
# proposal rule cut-offs (fixed values)
PROPOSE_MISSING = 0.30  # missing share above which knn / iterative imputation is preferred
PROPOSE_MINORITY = 0.05  # minority share below which smote / class_weight is preferred
PLAN_SCHEMA = (
    "plan_id string, imputation string, outlier_handling string, encoding string, scaling string, "
    "model string, imbalance_strategy string, model_params string"
)


def search_space(spark: SparkSession, task: str) -> DataFrame:
    """O-3: every combination; 1440 plans for classification, 576 for regression."""
    models = REGRESSORS if task == "regression" else CLASSIFIERS
    imb = ["none"] if task == "regression" else IMBALANCE
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in IMPUTERS])).alias("imputation"))
    for name, vals in (("outlier_handling", OUTLIERS), ("encoding", ENCODERS), ("scaling", SCALERS),
                       ("model", models), ("imbalance_strategy", imb)):
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in vals])))
    return grid.select(*AXES)


def plan_key(prefix: str = "", seed: int = 42):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(prefix), *[F.col(a) for a in AXES]))


def sample_plans(space: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """O-4 sampling step: n plans in seeded pseudo-random order (the sample size is the feature)."""
    h = plan_key("sample", seed)
    return (
        space.withColumn("__h", h)
        .orderBy("__h")
        .limit(n)
        .select(F.concat(F.lit("search_"), F.substring("__h", 1, 8)).alias("plan_id"), *AXES,
                F.lit("{}").alias("model_params"))
    )


def rule_plan(issues: DataFrame, task: str) -> DataFrame:
    """O-1: the fixed rule baseline plan from the issues frame (one row).

    knn imputation if missingness is HIGH, else median; winsorize + robust if
    outliers are HIGH, else none + standard; one-hot; class weights if
    imbalance is HIGH or MEDIUM; ridge for regression, else logistic regression.
    """
    flags = issues.agg(
        F.max(((F.col("issue_type") == "high_missingness") & (F.col("severity") == "high")).cast("int")).alias("hm"),
        F.max(((F.col("issue_type") == "outliers") & (F.col("severity") == "high")).cast("int")).alias("ho"),
        F.max(((F.col("issue_type") == "class_imbalance") & F.col("severity").isin("high", "medium")).cast("int")).alias("ci"),
    )
    model = "ridge" if task == "regression" else "logistic_regression"
    return flags.select(
        F.lit("rule_based").alias("plan_id"),
        F.when(F.col("hm") == 1, "knn").otherwise("median").alias("imputation"),
        F.when(F.col("ho") == 1, "winsorize").otherwise("none").alias("outlier_handling"),
        F.lit("onehot").alias("encoding"),
        F.when(F.col("ho") == 1, "robust").otherwise("standard").alias("scaling"),
        F.lit(model).alias("model"),
        F.when(F.col("ci") == 1, "class_weight").otherwise("none").alias("imbalance_strategy"),
        F.lit("{}").alias("model_params"),
    )


def propose(issues: DataFrame, history: DataFrame | None, memory_plans: DataFrame | None, task: str,
            n: int = 3, seed: int = 42, round_no: int = 1) -> DataFrame:
    """O-5: n new plans per round (re-aimed from the hosted planner's decision rules).

    * never repeat a tried (model, imputation, encoding, scaling);
    * HIGH issues bias the axes: missing > 30 % -> knn/iterative, outliers ->
      winsorize + robust, minority < 5 % -> smote/class_weight;
    * plans equal to a remembered plan (warm start) rank first;
    * model families vary: the best plan of each model is taken before any
      second plan of the same model.
    """
    spark = issues.sparkSession
    space = search_space(spark, task)
    if history is not None:
        tried = history.select("model", "imputation", "encoding", "scaling").distinct()
        space = space.join(tried, ["model", "imputation", "encoding", "scaling"], "left_anti")
    ev = F.col("evidence")
    f = issues.agg(
        F.max(((F.col("issue_type") == "high_missingness") & (F.col("severity") == "high")
               & (ev["missing_rate"] > PROPOSE_MISSING)).cast("int")).alias("miss"),
        F.max(((F.col("issue_type") == "outliers") & (F.col("severity") == "high")).cast("int")).alias("outl"),
        F.max(((F.col("issue_type") == "class_imbalance") & (F.col("severity") == "high")
               & (ev["minority_rate"] < PROPOSE_MINORITY)).cast("int")).alias("imb"),
    ).first()
    miss, outl, imb = (int(f[k] or 0) for k in ("miss", "outl", "imb"))
    score = (
        F.lit(0)
        + F.when(F.col("imputation").isin("knn", "iterative"), miss).otherwise(0)
        + F.when(F.col("outlier_handling") == "winsorize", outl).otherwise(0)
        + F.when(F.col("scaling") == "robust", outl).otherwise(0)
        + F.when(F.col("imbalance_strategy").isin("smote", "class_weight"), imb).otherwise(0)
    )
    space = space.withColumn("__score", score.cast("int"))
    if memory_plans is not None:
        # remembered plans come from a top-k lookup (k rows): a bounded broadcast
        mem = memory_plans.select(*AXES).distinct().withColumn("__mem", F.lit(1))
        space = space.join(F.broadcast(mem), AXES, "left").withColumn(
            "__score", F.col("__score") + 10 * F.coalesce("__mem", F.lit(0))
        ).drop("__mem")
    space = space.withColumn("__h", plan_key(f"round{round_no}", seed))
    w = Window.partitionBy("model").orderBy(F.desc("__score"), "__h")
    ranked = space.withColumn("__rn", F.row_number().over(w))
    top = ranked.orderBy("__rn", F.desc("__score"), "__h").limit(n)
    return top.select(
        F.concat(F.lit("plan_"), F.substring("__h", 1, 8)).alias("plan_id"), *AXES, F.lit("{}").alias("model_params")
    )


PROPOSAL_SCHEMA = T.StructType([
    T.StructField("plans", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    T.StructField("reasoning", T.StringType()),
])


def validate_proposals(docs: DataFrame, n: int, text_col: str = "doc", id_col: str = "doc_id"):
    """O-6: parse proposal JSON documents ``{"plans": [...], "reasoning": str}``.

    Returns (accepted, rejected).  Accepted: at most ``n`` plans per document,
    each with all six required fields, fresh ids ``plan_<hash>``; rejected:
    one row per bad document with the reason (invalid JSON, missing fields in
    plan i, or zero plans).  Explanations move into ``model_params`` under
    ``__explanation``.
    """
    parsed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("doc"),
        F.from_json(F.col(text_col), PROPOSAL_SCHEMA, {"mode": "PERMISSIVE"}).alias("j"),
        F.get_json_object(F.col(text_col), "$").isNotNull().alias("valid"),
    )
    plans = parsed.select(
        "doc_id", "doc", "valid", F.col("j.reasoning").alias("reasoning"),
        F.slice(F.coalesce(F.col("j.plans"), F.array().cast("array<map<string,string>>")), 1, n).alias("plans"),
    )
    exploded = plans.select("doc_id", "doc", "valid", "reasoning", F.posexplode_outer("plans").alias("i", "p"))
    missing = F.filter(F.array(*[F.lit(a) for a in REQUIRED_FIELDS]), lambda a: ~F.map_contains_key(F.col("p"), a))
    checked = exploded.withColumn("missing", missing)
    bad_doc = checked.groupBy("doc_id").agg(
        F.first("valid").alias("valid"),
        F.max(F.when(F.col("p").isNotNull(), 1).otherwise(0)).alias("has_plans"),
        F.min_by(F.struct("i", "missing"), F.when(F.size("missing") > 0, F.col("i"))).alias("first_bad"),
        F.max(F.when(F.size("missing") > 0, 1).otherwise(0)).alias("any_bad"),
    )
    reason = (
        F.when(~F.col("valid"), F.lit("invalid_json"))
        .when(F.col("any_bad") == 1, F.concat(F.lit("plan "), F.col("first_bad.i").cast("string"),
                                              F.lit(" missing fields: "), F.array_join(F.array_sort("first_bad.missing"), ",")))
        .when(F.col("has_plans") == 0, F.lit("zero_plans"))
    )
    verdict = bad_doc.select("doc_id", reason.alias("reason"))
    rejected = verdict.where(F.col("reason").isNotNull())
    ok_docs = verdict.where(F.col("reason").isNull()).select("doc_id")
    accepted = checked.join(ok_docs, "doc_id", "left_semi").where(F.col("p").isNotNull())
    loose = F.map_filter(F.col("p"), lambda k, v: ~k.isin(*REQUIRED_FIELDS, "plan_id", "plain_language_explanation", "model_params"))
    nested = F.coalesce(F.from_json(F.col("p")["model_params"], "map<string,string>"), F.create_map().cast("map<string,string>"))
    # a parameter named both inside and beside model_params takes the inner value
    params = F.map_concat(F.map_filter(loose, lambda k, v: ~F.map_contains_key(nested, k)), nested)
    accepted = accepted.select(
        "doc_id",
        F.col("i").alias("position"),
        F.concat(F.lit("plan_"), F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("i").cast("string"),
                                                             F.col("doc"))), 1, 8)).alias("plan_id"),
        *[F.col("p")[a].alias(a) for a in AXES],
        F.to_json(F.when(F.col("p")["plain_language_explanation"].isNotNull(),
                         F.map_concat(params, F.create_map(F.lit("__explanation"), F.col("p")["plain_language_explanation"])))
                  .otherwise(params)).alias("model_params"),
    )
    return accepted, rejected
