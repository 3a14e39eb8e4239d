"""Cross-run plan memory (S-7, S-8, O-8, O-9).

An append-only Parquet dataset of (fingerprint array<double>, plan struct,
dataset_name, created_at).  Lookup is exact cosine top-k: a per-row
expression against the query fingerprint followed by a bounded top-k, i.e.
one scan with a k-row result (no index; the store grows by one row per run).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.vectors import cosine, log_scale

PLAN_STRUCT = T.StructType([
    T.StructField(n, T.StringType())
    for n in ("plan_id", "imputation", "outlier_handling", "encoding", "scaling", "model", "imbalance_strategy", "model_params")
])
MEMORY_SCHEMA = T.StructType([
    T.StructField("fingerprint", T.ArrayType(T.DoubleType())),
    T.StructField("plan", PLAN_STRUCT),
    T.StructField("dataset_name", T.StringType()),
    T.StructField("created_at", T.StringType()),
])


class PlanMemory:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(conf).exists(p)

    def table(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], MEMORY_SCHEMA)
        return self.spark.read.schema(MEMORY_SCHEMA).parquet(self.path)

    def append(self, fingerprint: list[float], plan: dict, dataset_name: str = "") -> None:
        """S-7 / O-9: store one successful (fingerprint, plan); duplicates allowed."""
        row = (
            [float(x) for x in fingerprint],
            tuple(None if plan.get(f.name) is None else str(plan.get(f.name)) for f in PLAN_STRUCT.fields),
            dataset_name,
        )
        df = self.spark.createDataFrame([row], "fingerprint array<double>, plan " + PLAN_STRUCT.simpleString() + ", dataset_name string")
        df = df.withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
        df.write.mode("append").parquet(self.path)

    def count(self) -> int:
        """S-8."""
        return self.table().count() if self._exists() else 0

    def similar(self, fingerprint: list[float], k: int = 3, log_scaled: bool = False) -> DataFrame:
        """O-8: top-k stored entries by cosine similarity to ``fingerprint`` (<= k rows)."""
        return top_k_cosine(self.table(), "fingerprint", [float(x) for x in fingerprint], k, log_scaled)


def top_k_cosine(df: DataFrame, vec_col: str, query: list[float], k: int = 3, log_scaled: bool = False,
                 tie_cols: list[str] | None = None) -> DataFrame:
    """Exact cosine top-k of every row's vector against one query vector (the k is the feature)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(vec_col)
    if log_scaled:
        q, v = log_scale(q), log_scale(v)
    scored = df.withColumn("similarity", cosine(v, q))
    order = [F.desc_nulls_last("similarity")] + [F.col(c) for c in (tie_cols or [])]
    return scored.orderBy(*order).limit(k)


MAX_QUERY_VECTORS = 10_000  # query sets are collected to the driver only below this checked size


def top_k_per_query(items: DataFrame, item_vec: str, item_key: str, queries: list[tuple], k: int = 3) -> DataFrame:
    """Cosine top-k of the items for each of a small list of ``(query_key, vector)``.

    Query vectors are literals of the plan (their count is checked), so each
    item row yields one similarity per query by projection; ``row_number <= k``
    per query is planned with a partial window-group limit, so each task ships
    at most k rows per query before the exchange.
    """
    if len(queries) > MAX_QUERY_VECTORS:
        raise ValueError(f"{len(queries)} query vectors exceed the broadcast bound {MAX_QUERY_VECTORS}")
    v = F.col(item_vec)
    sims = F.array(*[
        F.struct(F.lit(qk).alias("query"), cosine(v, F.array(*[F.lit(float(x)) for x in qv])).alias("similarity"))
        for qk, qv in queries
    ])
    scored = items.select(F.col(item_key), F.explode(sims).alias("s")).select(item_key, "s.query", "s.similarity")
    w = Window.partitionBy("query").orderBy(F.desc_nulls_last("similarity"), F.col(item_key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
