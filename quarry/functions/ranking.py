"""Global dense numbering without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import checkpoint

#: ``monotonically_increasing_id`` keeps the partition above this bit and the row below it.
PARTITION_BIT = 33


def dense_codes(values: DataFrame, col: str, out: str = "code") -> DataFrame:
    """(value, code) with code = 0..n-1 in ascending value order.

    Spark range-partitions and sorts the distinct values; a code is the row's
    place in its partition plus the sizes of the partitions before.  The
    sorted values are checkpointed, so places and sizes come from the same
    layout.  The size table has one row per partition, whatever the input.
    """
    values = values.select(F.col(col)).where(F.col(col).isNotNull()).distinct()
    return positions(values, [col], out)


def positions(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """``rows`` with ``out`` (long): each row's place from 0 in ascending ``order``, which must tell all rows apart."""
    part, place = F.shiftright("__at", PARTITION_BIT), F.col("__at").bitwiseAND((1 << PARTITION_BIT) - 1)
    placed = checkpoint(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.select(*rows.columns, part.alias("__part"), place.alias("__place"))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").select(*rows.columns, (F.col("__start") + F.col("__place")).alias(out))


def running_totals(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``rows`` with, for each (column, name) of ``sums``, the column's total over all rows before in ascending ``order``.

    A prefix scan: rows are range-partitioned and sorted, each partition adds up
    in one pass from 0 and is written to the checkpoint folder, then the totals
    of the partitions before (one row per partition) are added.  Rows that are
    equal in ``order`` get no defined order among them; NULL comes last.
    """
    from pyspark.sql import types as T

    cols, names = list(sums), list(sums.values())
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T.LongType()) for n in names], T.StructField("__part", T.IntegerType())])

    def scan(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        carried = [0] * len(cols)
        for batch in batches:
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            for k, c in enumerate(cols):
                v = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                upto = np.cumsum(v, dtype=np.int64) + carried[k]
                arrays.append(pa.array(upto - v, type=pa.int64()))
                carried[k] = int(upto[-1]) if len(v) else carried[k]
            arrays.append(pa.array(np.full(batch.num_rows, part, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *names, "__part"])

    scanned = checkpoint(rows.orderBy(*[F.col(c).asc_nulls_last() for c in order]).mapInArrow(scan, schema))
    totals = scanned.groupBy("__part").agg(*[F.sum(c).alias(f"__t{k}") for k, c in enumerate(cols)])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", *[F.coalesce(F.sum(f"__t{k}").over(before), F.lit(0)).alias(f"__o{k}") for k in range(len(cols))])
    return scanned.join(F.broadcast(starts), "__part").select(
        *rows.columns, *[(F.col(n) + F.col(f"__o{k}")).alias(n) for k, n in enumerate(names)])
