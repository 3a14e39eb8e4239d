"""Hierarchical weighted hash tree: documents to shards through regions and racks.

A document descends region -> rack -> shard.  At each level every child makes
one hash draw ``-ln(u) / weight`` for the document's key and the smallest draw
wins, so a child gets a share of the keys in proportion to its weight (the sum
of the weights below it).  When a shard is added, its weight enters the region
and the rack above it as a draw of its own; all older draws stay as they were.
A key either loses to the new draw at the top and follows it straight to the
new shard, or keeps its whole path.  Movement is confined to the changed
subtree, and there to its new leaf.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.ranks import position_in_group
from quarry.llm.stage import read_table, staged

#: The query's tree: 3 regions with 4, 3 and 3 racks and 40 shards of weight 1.
REGIONS = ((4, 4, 4, 4), (5, 5, 4), (4, 3, 3))
ROW_OVERHEAD = 16


@dataclass(frozen=True)
class HashTree:
    """``weights[region][rack]`` lists the shards' weights; ``added`` the (region, rack, weight) of later shards."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]
    added: tuple[tuple[int, int, float], ...] = ()

    def __post_init__(self):
        flat = [w for region in self.weights for rack in region for w in rack] + [a[2] for a in self.added]
        if not flat or any(not w > 0 for w in flat) or any(not rack for region in self.weights for rack in region):
            raise ValueError("every rack needs a shard and every shard a positive weight")

    @classmethod
    def uniform(cls, regions: Sequence[Sequence[int]]) -> HashTree:
        return cls(tuple(tuple((1.0,) * n for n in region) for region in regions))

    @property
    def n_shards(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region) + len(self.added)

    def grown(self, region: int, rack: int, weight: float = 1.0) -> HashTree:
        """The tree with one more shard (numbered next) in a rack."""
        self.weights[region][rack]
        return HashTree(self.weights, (*self.added, (region, rack, float(weight))))

    def shard(self, key: Column) -> Column:
        """The shard number (int) of a key column, as an expression without shuffles or Python."""

        def draw(node: str, weight: float) -> Column:
            # 52 bits, centred: never 0 or 1
            u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 12) + 0.5) / float(1 << 52)
            return -F.log(u) / F.lit(float(weight))

        def choose(options: list[tuple[str, float, Column]]) -> Column:
            if len(options) == 1:
                return options[0][2]
            # a struct orders by draw, then by the option's place
            best = F.array_min(F.array(*[F.struct(draw(n, w).alias("d"), F.lit(i).alias("i")) for i, (n, w, _) in enumerate(options)]))["i"]
            return F.element_at(F.array(*[c for *_, c in options]), best + 1) if all(c is not None for *_, c in options) else best

        number, regions = 0, []
        for r, region in enumerate(self.weights):
            racks = []
            for k, rack in enumerate(region):
                leaves = [(f"{r}/{k}/{s}", w, F.lit(number + s)) for s, w in enumerate(rack)]
                number += len(rack)
                racks.append((f"{r}/{k}", sum(rack), leaves))
            regions.append((f"{r}", sum(w for _, w, _ in racks), racks))
        late = [(f"added/{j}/{r}/{k}", w, j) for j, (r, k, w) in enumerate(self.added)]

        # descend lazily: only the chosen subtree's draws are evaluated
        def branch(options, deeper):
            names = [(n, w, F.lit(i)) for i, (n, w, _) in enumerate(options)]
            best = choose(names)
            if len(options) == 1:
                return deeper(options[0][2])
            out = None
            for i, (_, _, below) in enumerate(options):
                out = (F.when if out is None else out.when)(best == i, deeper(below))
            return out

        top = [*regions, *[(n, w, number + j) for n, w, j in late]]
        return branch(top, lambda x: F.lit(x) if isinstance(x, int) else branch(x, choose)).cast("int")


def assign_shards(df: DataFrame, tree: HashTree, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """Add the shard of each row's key; other columns pass through.

    Equal keys share a shard.  A null key is a key of its own.  An empty table
    stays empty.  ``out`` must not name a column of ``df``.
    """
    if out in df.columns:
        raise ValueError(f"column {out!r} exists already")
    return df.withColumn(out, tree.shard(F.coalesce(F.col(key).cast("string"), F.lit("\u0000null"))))


def shard_table(docs: DataFrame, tree: HashTree, grown: HashTree) -> DataFrame:
    """One row per document: size, text checksum, shard, gapless slot and the shard after growth.

    Rows need ``doc_id`` and ``text``; other columns are dropped.  A null text
    has no bytes (size 16, checksum 0).  Slots run by a hash part and doc_id;
    repeated rows get slots of their own.  The texts never enter a shuffle.
    """
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(raw) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = staged(assign_shards(assign_shards(rows, tree), grown, out="grown_shard"), "shards")
    placed = position_in_group(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard")


def query(spark, sf_dir: str) -> DataFrame:
    tree = HashTree.uniform(REGIONS)
    return shard_table(read_table(spark, sf_dir, "documents"), tree, tree.grown(2, 1))
