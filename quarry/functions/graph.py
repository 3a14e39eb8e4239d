"""Connected components of a graph of any size by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import checkpoint

#: The edges of one node are dealt to so many tasks.
DEALS = 16


def _with_minimum(edges: DataFrame, minima: DataFrame) -> DataFrame:
    """``edges`` with ``m`` of their ``u``; the edges of a hub are dealt by ``v``, its minimum goes to each deal."""
    dealt = edges.withColumn("deal", F.pmod(F.xxhash64("v"), F.lit(DEALS)).cast("int"))
    spread = minima.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    return dealt.join(spread, ["u", "deal"]).drop("deal")


def _local_trees():
    """A function for ``mapInArrow``, made here so that it travels to the workers by value."""
    import pyarrow as pa

    def trees(batches):
        """The edges of one partition as (node, smallest node of its tree in this partition)."""
        above: dict[int, int] = {}

        def top(node):
            path = []
            while node in above:
                path.append(node)
                node = above[node]
            for seen in path:
                above[seen] = node
            return node

        for batch in batches:
            for u, v in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                low, high = sorted((top(u), top(v)))
                if low != high:
                    above[high] = low
        nodes = list(above)
        for at in range(0, len(nodes), 10_000):
            part = nodes[at : at + 10_000]
            yield pa.RecordBatch.from_pydict({"u": pa.array(part, pa.int64()), "v": pa.array([top(n) for n in part], pa.int64())})

    return trees


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (two long columns u, v); comp is the smallest node reachable.

    Each partition first replaces its edges by union-find trees, in memory that
    follows the partition.  Large-star and small-star steps repeat until no edge changes; their number
    grows with the logarithm of the longest path.  Each step is checkpointed, and
    its joins deal the edges of a node to several tasks.
    """
    nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    e = checkpoint(edges.where("u <> v").select("u", "v").mapInArrow(_local_trees(), "u long, v long").distinct())
    seen = None
    while True:
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_minimum(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        best = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_minimum(large, best).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.unionByName(best.select("u", F.col("m").alias("v"))).distinct())
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("comp")), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
