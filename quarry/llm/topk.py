"""Exact top-k inner-product search by tiled matrix products.

Queries and candidates are dealt into blocks of bounded size by a hash of
their id.  Every (query block, candidate shard) pair is one tile: a matrix
product, then the k best of each query row.  The per-tile lists are merged in
a tree whose nodes take ``FAN_IN`` shards each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.stage import read_table, staged

TILE_QUERIES, TILE_ROWS, FAN_IN = 2048, 8192, 32
HITS = "query_id long, vec_id long, score long"


def quantised(values: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null for null vectors and vectors with a null or non-finite component."""
    wide = F.transform(values, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(wide, lambda x: F.floor(x * scale)))


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, rows) in id order; rows that repeat an id all stay."""
    ids = t.column("vec_id").to_numpy()
    at = np.argsort(ids, kind="stable")
    flat = t.column("v").combine_chunks().flatten().to_numpy()
    return ids[at], flat.reshape(t.num_rows, -1)[at]


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products, in the narrowest float type that is exact for these rows."""
    bound = np.sqrt((q.astype(np.float64) ** 2).sum(1).max(initial=0)) * np.sqrt((c.astype(np.float64) ** 2).sum(1).max(initial=0)) * 1.001
    for kind, limit in ((np.float32, 2.0**24), (np.float64, 2.0**53)):
        if bound < limit:
            return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)
    if bound < 2.0**63:
        return q @ c.T
    raise OverflowError("an inner product exceeds 64 bits")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id; ids ascend."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > kth)
        level = np.flatnonzero(scores == kth)[: k - len(above)]
        keep = np.concatenate([above, level])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))]


def _tile(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            (qid, q), (cid, c) = _matrix(left), _matrix(right)
            rows = max(1, (16 << 20) // (8 * max(1, len(cid))))
            for lo in range(0, len(qid), rows):
                scores = _product(q[lo : lo + rows], c)
                for i, row in enumerate(scores):
                    own = np.searchsorted(cid, qid[lo + i], side="left"), np.searchsorted(cid, qid[lo + i], side="right")
                    others, part = (np.delete(x, slice(*own)) for x in (cid, row)) if own[0] < own[1] else (cid, row)
                    best = _best(others, part, k)
                    out_q.append(np.full(len(best), qid[lo + i]))
                    out_v.append(others[best])
                    out_s.append(part[best])
        parts = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (out_q, out_v, out_s)]
        lead = [pa.array(np.full(len(parts[0]), right.column("shard")[0].as_py() if right.num_rows else 0), pa.int32())]
        return pa.table([*lead, *map(pa.array, parts)], names=["shard", "query_id", "vec_id", "score"])

    return run


def exact_topk(queries: DataFrame, rows: DataFrame, k: int = 5, tile_queries: int = TILE_QUERIES, tile_rows: int = TILE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of each query.

    Both inputs have vec_id (long) and v (array of long).  Rows with a null id
    or vector take no part, nor does the query's own id.  Rows that repeat an
    id count each, as candidates and as queries of one id.  Vectors of different lengths do not meet.  Ties go to the
    smaller vec_id; a query with fewer than k candidates returns them all.
    Empty inputs give an empty result.
    """
    rows = rows.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    queries = queries.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    n_rows, n_queries = rows.count(), queries.count()
    shards, blocks = max(1, -(-n_rows // tile_rows)), max(1, -(-n_queries // tile_queries))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dim = F.size("v").alias("dim")
    right = rows.select("vec_id", "v", dim, place(shards).alias("shard")).select("*", spread(blocks).alias("block"))
    left = queries.select("vec_id", "v", dim, place(blocks).alias("block")).select("*", spread(shards).alias("shard"))
    keys = ["dim", "block", "shard"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(k), f"shard int, {HITS}")
    hits = staged(hits, "topk")
    order = [F.desc("score"), F.asc("vec_id")]
    width = shards
    while True:
        width = -(-width // fan_in)
        hits = hits.withColumn("shard", F.floor(F.col("shard") / fan_in).cast("int"))
        node = Window.partitionBy("query_id", "shard").orderBy(*order)
        hits = hits.withColumn("rank", F.row_number().over(node)).where(F.col("rank") <= k)
        if width <= 1:
            return hits.select("query_id", "rank", "vec_id", "score")
        hits = hits.drop("rank")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("v"))
    return exact_topk(vectors.where(F.col("vec_id") % 50 == 0), vectors)


ORACLE = """
WITH raw AS (
    SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
    FROM embeddings
), vecs AS (
    SELECT vec_id, v FROM raw
    WHERE v IS NOT NULL AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM vecs q JOIN vecs c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
