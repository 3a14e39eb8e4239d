"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

from quarry.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; the caller's cluster clears that folder."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/quarry-llm/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch of whole texts; a task holds a batch on both sides of its Python worker.
TEXT_ROWS, BATCH_KEY = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def text_batches(spark: SparkSession):
    """Arrow batches of at most TEXT_ROWS rows for the jobs run inside; the session's own setting comes back."""
    before = spark.conf.get(BATCH_KEY)
    if 0 < int(before) <= TEXT_ROWS:
        yield
        return
    spark.conf.set(BATCH_KEY, str(TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def staged(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later plans start from the files: nothing upstream runs twice, row order
    and ids are fixed, and a lost executor loses nothing.  With ``texts``,
    Python workers get the rows in small batches.
    """
    path = shared_folder(df.sparkSession, name)
    with text_batches(df.sparkSession) if texts else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
