"""Table readers (S-1 .. S-3) and CSV export (S-9)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet"}


def spread(df: DataFrame) -> DataFrame:
    """Give a thinly split input at least one partition per core.

    A file written as one row group scans in one task, and every operator
    fused into that scan (unpivots, partial aggregates) then runs on one core.
    When the scan has fewer splits than the session's default parallelism the
    rows are round-robin repartitioned to it; inputs that are already split
    wider (any large table) are returned unchanged, so no extra shuffle.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def load_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """S-3: dispatch on the lower-cased suffix; unknown suffixes raise ValueError.

    CSV (S-1) is read with a header and an inferred schema unless one is given
    (dates stay strings, as in the modelled tool); Parquet (S-2) uses its own.
    """
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    fmt = FORMATS.get(suffix)
    if fmt is None:
        raise ValueError(f"Unsupported file format: '{suffix}'. Use .csv, .parquet or .pq")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        if schema is None:
            found = reader.csv(path, header=True, inferSchema=True).schema
            temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
            schema = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, temporal) else f.dataType) for f in found])
        return spread(spark.read.schema(schema).csv(path, header=True))
    return spread(reader.parquet(path))


def write_csv(df: DataFrame, path: str, single_file: bool = True) -> None:
    """S-9: export a (small) result table as CSV with a header.

    Result tables here are summaries (one row per variant/attempt/column), so
    coalescing to one file is bounded; set ``single_file=False`` for big ones.
    """
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
