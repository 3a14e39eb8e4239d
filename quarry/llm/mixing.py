"""Mixing sources to target weights by pivotal dependent rounding.

A source whose target is r times its size takes floor(r) whole copies of each
document and one more with probability f = r - floor(r).  The extra copies are
not drawn one by one: two documents with fractional probabilities pass words
between them, at random but without bias, until one of them is taken or left.
The expected words of every document and the sum over the source stay as they
are, so only the last open document of a source decides by a coin.

Documents are dealt into leaves by a hash; each leaf passes one residual
document on, and residuals are combined in a tree of ``FAN_IN`` children a node
up to one root for each source.  A step needs nothing but the open residual.
The root, of at most one leaf's or ``FAN_IN`` rows, is rounded ``TRIES`` times
and keeps the rounding, coin included, that ends nearest to the target.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.stage import read_table, staged

WEIGHTS, MOST_COPIES = (5, 2, 1), 3
SEED, LEAF_ROWS, FAN_IN, SALTS, BLOCK, TRIES = 7, 2000, 1000, 32, 100_000, 16
WORD = r"[^ \t-\r]+"


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """Add ``number`` (int from 0) by code point, null last: ranks inside ranges plus the ranges' offsets."""
    ranged = sizes.repartitionByRange(F.asc_nulls_last("source")).withColumn("_range", F.spark_partition_id())
    ranged = staged(ranged, "mix-sources")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.asc_nulls_last("source")))
    out = ranged.withColumn("_in", inside).join(offsets, "_range")
    return out.withColumn("number", (F.col("_offset") + F.col("_in") - 1).cast("int")).drop("_range", "_in", "_offset")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, number, target: shares of the sum of all sizes.

    Sources weigh ``weights`` in turn.  A target stops at ``most`` times its
    source's size; what is over goes to the other sources by weight, round by
    round, until no target is above.  Sources are a table of any length; each
    round is one aggregate over it.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("number") % len(weights) + 1)
    rows = staged(numbered_sources(sizes).select("*", weight.alias("weight"), F.lit(False).alias("full")), "mix-numbered")
    cap = (F.col("source_size") * most).cast("double")
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        held = rows.agg(F.sum(F.when(F.col("full"), cap)).alias("capped"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("weight")).first()
        share = F.lit(total - (held.capped or 0.0)) * F.col("weight") / F.lit(held.weight or 1.0)
        over = ~F.col("full") & (share > cap)
        # what is reshared only raises the other shares, so a full source stays full
        if not rows.where(over).limit(1).count():
            return rows.select("source", "source_size", "number", F.when(F.col("full"), cap).otherwise(share).alias("target"))
        rows = staged(rows.withColumn("full", F.col("full") | over), "mix-capped")


def _step(a: float, b: float, p: float, q: float, draw: float) -> tuple[float, float]:
    """Pass words between two documents of a and b words until one of p and q is 0 or 1; a p + b q and both means stay."""
    x, y = a * p, b * q
    up, down = min(a - x, y), min(x, b - y)  # words that the first can win from the second, or lose to it
    if draw * (up + down) < down:
        return (1.0 if up == a - x else (x + up) / a), (0.0 if up == y else (y - up) / b)
    return (0.0 if down == x else (x - down) / a), (1.0 if down == b - y else (y + down) / b)


def _pivot(batches):
    """Rows sorted by (number, node) and, inside, by size from large to small -> the same rows with p settled.

    p becomes 0 or 1 but for at most one row of each node, its residual.
    """
    held = None  # the open row of the current node, as a batch of one row
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.Table.from_batches([held, batch])
        number, node, size, p, draw = (table.column(c).to_numpy().tolist() for c in ("number", "node", "size", "p", "draw"))
        i = None  # place of the open row
        for j, q in enumerate(p):
            if not 0.0 < q < 1.0:
                continue
            if i is None or number[i] != number[j] or node[i] != node[j]:
                i = j
                continue
            p[i], p[j] = _step(size[i], size[j], p[i], q, draw[j])
            if not 0.0 < p[i] < 1.0:
                i = j if 0.0 < p[j] < 1.0 else None
        at = table.schema.get_field_index("p")
        table = table.set_column(at, table.schema.field(at), pa.array(p, pa.float64())).combine_chunks()
        last = table.num_rows - 1
        if i is not None and number[i] == number[last] and node[i] == node[last]:
            held = table.slice(i, 1).combine_chunks().to_batches()[0]
            table = pa.concat_tables([table.slice(0, i), table.slice(i + 1)]).combine_chunks()
        else:
            held = None
        yield from table.to_batches()
    if held is not None:
        yield held


def landed(size: list[int], p: list[float], seed: int, tries: int = TRIES) -> list[float]:
    """p of one root settled to 0 and 1: of ``tries`` roundings the one whose words come nearest to the sum of size * p."""
    want = sum(a * q for a, q in zip(size, p, strict=True))
    rng, best, least = np.random.default_rng(seed), p, None
    for _ in range(tries):
        draws, out, i = rng.random(len(p) + 1).tolist(), list(p), None
        for j, q in enumerate(p):
            if not 0.0 < q < 1.0:
                continue
            if i is None:
                i = j
                continue
            out[i], out[j] = _step(size[i], size[j], out[i], q, draws[j])
            if not 0.0 < out[i] < 1.0:
                i = j if 0.0 < out[j] < 1.0 else None
        if i is not None:
            out[i] = float(draws[-1] < out[i])
        off = abs(sum(a * q for a, q in zip(size, out, strict=True)) - want)
        if least is None or off < least:
            best, least = out, off
        if i is None:
            break
    return best


def _land(batches):
    """Rows sorted by number and size: the whole root of each source, then its rows with p settled."""
    held: list[pa.Table] = []

    def settle():
        table = pa.concat_tables(held).combine_chunks()
        draw = table.column("draw").to_numpy()
        p = landed(table.column("size").to_pylist(), table.column("p").to_pylist(), int(draw[0] * (1 << 52)))
        at = table.schema.get_field_index("p")
        yield from table.set_column(at, table.schema.field(at), pa.array(p, pa.float64())).combine_chunks().to_batches()

    current = None
    for batch in batches:
        numbers = batch.column("number").to_numpy()
        starts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])) if len(numbers) else []
        for lo, hi in zip(starts, [*starts[1:], len(numbers)], strict=True):
            if held and numbers[lo] != current:
                yield from settle()
                held.clear()
            current = numbers[lo]
            held.append(pa.Table.from_batches([batch.slice(lo, hi - lo)]))
    if held:
        yield from settle()


def _settle(rows: DataFrame, level: int, seed: int, root: bool) -> DataFrame:
    """One level of the tree: each (number, node) keeps at most one fractional row, a root none."""
    draw = (F.shiftrightunsigned(F.xxhash64("doc_id", "size", "number", F.lit(seed), F.lit(level)), 12) + 0.5) / float(1 << 52)
    dealt = rows.withColumn("draw", draw).repartition("number", "node")
    ordered = dealt.sortWithinPartitions("number", "node", F.desc("size"), F.asc_nulls_last("doc_id"))
    return staged(ordered.mapInArrow(_land if root else _pivot, ordered.schema).drop("draw"), f"mix-level{level}")


def rounded(items: DataFrame, seed: int = SEED, leaf_rows: int = LEAF_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """items with p settled to 0 or 1; the words p * size of each ``number`` keep their sum but for one coin.

    ``items``: doc_id, size (> 0), number, p in [0, 1], other columns; rows
    differ in (doc_id, size, number).  Equal input gives equal output whatever
    its partitioning.
    """
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    nodes = max(1, -(-items.where(open_).count() // leaf_rows))
    node = F.pmod(F.xxhash64("doc_id", "size", "number", F.lit(seed)), F.lit(nodes)).cast("int")
    out = items.where(~open_).withColumn("node", F.lit(0))
    rows, level = items.where(open_).withColumn("node", node), 0
    while nodes > 1:
        rows = _settle(rows, level, seed, False)
        out = out.unionByName(rows.where(~open_))
        nodes, level = -(-nodes // fan_in), level + 1
        rows = rows.where(open_).withColumn("node", F.floor(F.col("node") / fan_in).cast("int"))
    return out.unionByName(_settle(rows, level, seed, True)).drop("node")


def repeated(rows: DataFrame, times: str, index: str, block: int = BLOCK) -> DataFrame:
    """Each row ``times`` (long) times, numbered from 0 in ``index``; a row of many copies is dealt out in blocks."""
    small = rows.where(F.col(times) <= block).withColumn("_b", F.lit(0).cast("long"))
    blocks = rows.where(F.col(times) > block).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({times} - 1) div {block}"))))
    both = small.unionByName(blocks.repartition(F.xxhash64(*[c for c in blocks.columns])))
    last = F.least(F.col(times), (F.col("_b") + 1) * block) - 1
    return both.withColumn(index, F.explode(F.sequence(F.col("_b") * block, last))).drop("_b")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, leaf_rows: int = LEAF_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: how often the mix takes each document.

    ``docs`` needs doc_id, text and source; other columns are dropped.  size is
    the number of words (runs without space and \\t..\\r); a null text has none
    and takes nothing.  A null source is a source, the last one.  Rows equal in
    doc_id, source and size share their copies as evenly as whole copies allow.
    copies lies between 0 and ``most``; taken is copies * size.  An empty table
    stays empty.  The texts never enter a shuffle.  Equal tables give equal
    results under any partitioning.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = staged(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")), "mix-sizes")
    alike = rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    targets = staged(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets")
    # each salt of a source meets its own copy of the source's row, so a hot source is spread
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    left = alike.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")).withColumnRenamed("source", "_source")
    right = targets.withColumn("_salt", salt)
    met = left.join(right, F.col("_source").eqNullSafe(F.col("source")) & (left["_salt"] == right["_salt"])).drop("_source", "_salt")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(rate), F.lit(most)).cast("long")
    extra = F.when(whole < most, (rate - whole) * F.col("n")).otherwise(F.lit(0.0))
    more = F.least(F.floor(extra), F.col("n")).cast("long")
    items = staged(met.select("*", whole.alias("whole"), more.alias("more"), F.when(F.col("size") > 0, extra - more).otherwise(0.0).alias("p")), "mix-items")
    settled = repeated(rounded(items, seed, leaf_rows, fan_in), "n", "i")
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("i") < F.col("more") + F.col("p")).cast("long")).otherwise(F.lit(0).cast("long"))
    out = settled.withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))
