"""Operator 4: nearest neighbours by a block matrix join.

Vectors are dealt into blocks by a hash of their id. For each pair of a query
block and a candidate block one task forms int8 tiles (each vector scaled to
-127..127; products of int8 tiles are exact in the float32 matrix product as
long as ``dim * 127 * 127`` stays below 2^24, else float64 is used). A tile
gives every inner product up to an error bound from the rounding residuals:

    |x.y - sx*sy*qx.qy| <= |x - sx*qx| * |y| + |sx*qx| * |y - sy*qy|

Pairs whose upper bound reaches the k-th best lower bound of their query
survive, are recomputed in float64 from the original vectors and kept in one
bounded heap per query; the heaps of a query's blocks are merged at the end.
The search is exact, so its recall is 1.

Equal vectors tie with each other everywhere, so at most k + 1 of them (the
smallest ids) can matter to any query; more are set aside before the tiles.
The group limit runs before the shuffle, so a vector that a third of all rows
share stays cheap.

Cases: vectors that are null, empty, zero or hold null or non-finite values
take no part, nor do rows with a null id. Repeated rows count once; of several
vectors under one id the smallest (by components) counts. Only vectors of
equal length are compared. Fewer than k candidates: all come back. Empty
tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blobtrail.llm.common import table, written

# --- fixed values ----------------------------------------------------------
K = 20
EVERY = 20  # queries: ids that this divides
BLOCK = 8192  # vectors of a block, about
# ---------------------------------------------------------------------------


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One finite, non-zero vector per id."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    d = d.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    return d.groupBy("id").agg(F.min("v").alias("v"))


class Tile:
    """Vectors of one block with their int8 form and rounding residuals."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        top = np.abs(vectors).max(axis=1)
        self.scale = np.where(top > 0, top / 127.0, 1.0)
        self.int8 = np.rint(vectors / self.scale[:, None]).astype(np.int8)
        rounded = self.int8 * self.scale[:, None]
        self.residual = np.linalg.norm(vectors - rounded, axis=1)
        self.norm = np.linalg.norm(vectors, axis=1)
        self.rounded_norm = np.linalg.norm(rounded, axis=1)

    def bounds(self, other: Tile) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all inner products with ``other``."""
        kind = np.float32 if self.vectors.shape[1] * 127 * 127 < 2**24 else np.float64
        product = (self.int8.astype(kind) @ other.int8.astype(kind).T).astype(np.float64)
        product *= self.scale[:, None] * other.scale[None, :]
        error = self.residual[:, None] * other.norm[None, :] + self.rounded_norm[:, None] * other.residual[None, :]
        error += 1e-12 * self.norm[:, None] * other.norm[None, :]  # of the float64 sums themselves
        return product - error, product + error


def best_of_block(queries: Tile, block: Tile, k: int, heaps: list[list]) -> None:
    """Feeds each query's heap of (score, -id) with the survivors."""
    low, high = queries.bounds(block)
    same = queries.ids[:, None] == block.ids[None, :]
    low[same], high[same] = -np.inf, -np.inf
    if low.shape[1] > k:
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
    else:
        floor = np.full(len(low), -np.inf)
    for q, heap in enumerate(heaps):
        least = max(floor[q], heap[0][0] if len(heap) == k else -np.inf)
        for c in np.nonzero((high[q] >= least) & ~same[q])[0]:
            item = (float(queries.vectors[q] @ block.vectors[c]), -int(block.ids[c]))
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)


def search(vectors: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k candidates with the largest
    inner product for every id that ``every`` divides."""
    rows = written(clean(vectors))
    queries = rows.where(F.pmod("id", F.lit(every)) == 0)
    alike = Window.partitionBy("v").orderBy("id")
    candidates = rows.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k + 1).drop("_n")
    n, nq = rows.count(), queries.count()
    c_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-nq // block))
    # Both sides by (query block, candidate block): each vector goes to one
    # row or column of the grid.
    own = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    cs = candidates.select(F.col("id").alias("c_id"), F.col("v").alias("c_v"), F.size("v").alias("dim"), own(c_blocks).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    qs = queries.select("id", "v", F.size("v").alias("dim"), own(q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"))

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            q = Tile(left["id"].to_numpy(), np.stack(left["v"].to_numpy()))
            heaps: list[list] = [[] for _ in range(len(q.ids))]
            # A few hundred rows at a time bound the size of the product.
            ids, vecs = right["c_id"].to_numpy(), right["c_v"].to_numpy()
            for at in range(0, len(ids), 1024):
                best_of_block(q, Tile(ids[at : at + 1024], np.stack(vecs[at : at + 1024])), k, heaps)
            out = [(int(i), -n, s) for i, heap in zip(q.ids, heaps, strict=True) for s, n in heap]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = (
        qs.groupBy("qb", "cb", "dim").cogroup(cs.groupBy("qb", "cb", "dim")).applyInPandas(tile, "query_id long, vec_id long, score double")
    )

    def merge(key: tuple, best: pd.DataFrame) -> pd.DataFrame:
        top = heapq.nsmallest(k, zip(-best["score"], best["vec_id"], strict=True))
        return pd.DataFrame([(key[0], r, int(i), -s) for r, (s, i) in enumerate(top, 1)], columns=["query_id", "rank", "vec_id", "score"])

    if c_blocks == 1:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
    return found.groupBy("query_id").applyInPandas(merge, "query_id long, rank int, vec_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
