"""Attempt log (S-4 .. S-6), one Parquet dataset partitioned by run and iteration.

Writes are one per round (never per row), and a round that is written again
replaces itself; reads prune partitions by ``run_id``.  Plans and metric maps are stored as JSON text, as in the
modelled tool's log, and decoded on read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_COLUMNS = [
    "id", "run_id", "iteration", "plan_id", "imputation", "outlier_handling", "encoding", "scaling", "model",
    "imbalance_strategy", "model_params", "score", "metric_values", "cv_std", "runtime_secs", "created_at", "seq",
]
LOG_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("iteration", T.IntegerType()),
    T.StructField("plan_id", T.StringType()),
    T.StructField("imputation", T.StringType()),
    T.StructField("outlier_handling", T.StringType()),
    T.StructField("encoding", T.StringType()),
    T.StructField("scaling", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("imbalance_strategy", T.StringType()),
    T.StructField("model_params", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("metric_values", T.StringType()),
    T.StructField("cv_std", T.DoubleType()),
    T.StructField("runtime_secs", T.DoubleType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("run_id", T.StringType()),
])


class AttemptLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(conf).exists(p)

    def append(self, run_id: str, iteration: int, attempts: DataFrame) -> None:
        """S-4: add one round of attempts (the attempts frame of ``evaluate_plans``).

        Only the partition of this run and iteration is overwritten, so a retried
        round is stored once; a round without attempts changes nothing.
        """
        rows = attempts.select(
            F.md5(F.concat_ws("|", F.lit(run_id), F.lit(str(iteration)), F.col("plan_id"), F.col("position").cast("string"))).alias("id"),
            F.lit(iteration).cast("int").alias("iteration"),
            "plan_id", "imputation", "outlier_handling", "encoding", "scaling", "model", "imbalance_strategy",
            F.col("model_params").cast("string").alias("model_params"),
            "score",
            F.to_json("metric_values").alias("metric_values"),
            "cv_std", "runtime_secs",
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at"),
            F.col("position").cast("int").alias("seq"),
            F.lit(run_id).alias("run_id"),
        )
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "iteration").parquet(self.path)

    def load(self, run_id: str) -> DataFrame:
        """S-5: attempts of one run ordered by iteration (then write order); unknown run -> empty."""
        if not self._exists():
            return self.spark.createDataFrame([], LOG_SCHEMA).select(*LOG_COLUMNS)
        df = self.spark.read.schema(LOG_SCHEMA).parquet(self.path).where(F.col("run_id") == run_id)
        return df.withColumn("metric_values", F.from_json("metric_values", "map<string,double>")).orderBy(
            "iteration", "seq"
        ).select(*LOG_COLUMNS)

    def runs(self) -> DataFrame:
        """S-6: distinct run ids, sorted."""
        if not self._exists():
            return self.spark.createDataFrame([], "run_id string")
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.path).select("run_id").distinct().orderBy("run_id")

    def all(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], LOG_SCHEMA).select(*LOG_COLUMNS)
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.path).withColumn(
            "metric_values", F.from_json("metric_values", "map<string,double>")
        ).select(*LOG_COLUMNS)
