"""Gapless positions inside groups of any size, without a task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def position_in_group(df: DataFrame, group: list[str], order: list[str], name: str, rows_per_part: int = 20_000, rows: int | None = None) -> DataFrame:
    """Add ``name`` (long, from 0): a gapless position of each row in its group.

    Each group is split by a hash of ``order`` into parts of about
    ``rows_per_part`` rows of the whole table, rows are numbered inside (group,
    part), and a running sum over the small table of part sizes gives each part
    its offset.  Both steps share one hash partitioning; a group with a third
    of all rows is spread like any other.  Rows equal in ``order`` are
    interchangeable.  ``df`` is used twice, so it should be a stored table.
    """
    rows = df.count() if rows is None else rows
    parts = max(8, -(-rows // rows_per_part))
    split = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    keys = [*group, "_part"]
    numbered = split.withColumn("_in_part", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    sizes = split.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return numbered.join(offsets, keys).withColumn(name, F.col("_offset") + F.col("_in_part")).drop("_part", "_in_part", "_offset")
