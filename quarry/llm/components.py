"""Connected components of a large graph: local union-find, then star contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import checkpoint

#: The edges of one node are dealt to so many tasks.
SALTS = 32


def _forest(batches):
    """Edges of one partition -> (u, v) with v the smallest node of u's tree here."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.get(top, top)) != top:
            top = p
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = list(parent)
    if nodes:
        tops = [root(x) for x in nodes]
        pairs = [(u, v) for u, v in zip(nodes, tops, strict=True) if u != v]
        for lo in range(0, len(pairs), 10_000):
            part = pairs[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in part], pa.int64()), pa.array([v for _, v in part], pa.int64())], names=["u", "v"])


def _salted(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _copied(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (two long columns); comp is the smallest node reachable.

    Each partition first reduces its edges to a spanning forest by union-find
    (its memory follows the partition, not the graph).  Large-star and
    small-star steps then join the forests until no edge changes, in a number
    of rounds that grows with the logarithm of the graph.  Minima are combined
    map-side, and joins are salted: only nodes that change an edge are copied,
    so the edges of a hub never meet in one task.
    """
    a, b = edges.columns
    e = checkpoint(edges.where(F.col(a) != F.col(b)).select(a, b).mapInArrow(_forest, "u long, v long").distinct())
    seen = None
    while True:
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        # u > v on every edge: v gives way to its own least neighbour
        least = _copied(e.groupBy("u").agg(F.min("v").alias("m"))).withColumnRenamed("u", "v")
        large = _salted(e, "u").join(least, ["v", "salt"], "left").select("u", F.coalesce("m", "v").alias("v"))
        best = large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
        several = _copied(best.where("m < most").select("u", "m"))
        small = _salted(large, "v").join(several, ["u", "salt"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.unionByName(best.select("u", F.col("m").alias("v"))).distinct())
    tops = e.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(tops)
