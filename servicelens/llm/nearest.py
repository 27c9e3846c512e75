"""Nearest neighbours by inner product with int8 tiles.

Vectors are rounded to int8 with one scale each. The product of a tile of rounded vectors is exact in
whole numbers; with the lengths of what rounding took away it bounds the true product. Pairs whose
upper bound reaches the k-th best lower bound are computed again from the original vectors in double
precision and kept in a heap per query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from servicelens.llm.common import read
from servicelens.llm.vectors import Searcher, finite, search_tiles

NEIGHBOURS = 20
QUERY_STEP = 20


class _Rounded:
    def __init__(self, vectors: np.ndarray):
        self.exact = vectors
        largest = np.abs(vectors).max(axis=1, keepdims=True)
        self.scale = largest / 127.0
        with np.errstate(all="ignore"):
            codes = np.nan_to_num(np.rint(vectors / self.scale))
        self.codes = np.clip(codes, -127, 127).astype(np.int8)
        rounded = self.codes * self.scale
        self.length = _norms(vectors)
        self.rounded_length = _norms(rounded)
        self.lost = _norms(vectors - rounded)


def _norms(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    top[top == 0] = 1.0
    return np.sqrt(np.square(x / top).sum(axis=1)) * top[:, 0]


class Int8Tile(Searcher):
    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int = NEIGHBOURS):
        self.ids, self.k = query_ids, k
        self.queries = _Rounded(queries)
        # sums of products of int8 stay whole numbers in single precision up to this length
        self.kind = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64
        self.codes = self.queries.codes.astype(self.kind)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        mine, theirs = self.queries, _Rounded(vectors)
        step = max(1, (1 << 22) // len(ids))
        for at in range(0, len(self.ids), step):
            part = slice(at, at + step)
            products = self.codes[part] @ theirs.codes.astype(self.kind).T
            near = products.astype(np.float64) * mine.scale[part] * theirs.scale[:, 0]
            error = mine.lost[part, None] * theirs.length + mine.rounded_length[part, None] * theirs.lost
            # room for the rounding of these figures themselves
            error += 1e-12 * mine.length[part, None] * theirs.length
            own = self.ids[part, None] == ids
            lower = np.where(own, -np.inf, near - error)
            if len(ids) > self.k:
                bound = np.partition(lower, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            else:
                bound = np.full(len(lower), -np.inf)
            held = np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.heaps[part]])
            hit = ~own & (near + error >= np.maximum(bound, held)[:, None])
            rows, columns = np.nonzero(hit)
            exact = np.zeros(rows.size)
            for j in range(vectors.shape[1]):  # in the order of the components, so that copies tie
                exact += mine.exact[at + rows, j] * vectors[columns, j]
            for row, other, score in zip((at + rows).tolist(), ids[columns].tolist(), exact.tolist(), strict=True):
                heap = self.heaps[row]
                if len(heap) < self.k:
                    heapq.heappush(heap, (score, -other))
                elif (score, -other) > heap[0]:
                    heapq.heapreplace(heap, (score, -other))

    def best(self) -> Iterator[tuple[int, int, float]]:
        for row, heap in enumerate(self.heaps):
            for score, other in heap:
                yield row, -other, score


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = NEIGHBOURS,
    query_step: int = QUERY_STEP,
) -> DataFrame:
    """The `k` largest inner products of every row whose id is divisible by `query_step`, itself aside.

    Returns query_id, rank, vec_id, score (in double precision on the original vectors); ties go to the
    smaller id. Null, empty or zero vectors, such with null or non-finite components and rows without
    an id take no part. Rows of another length than the query's are no candidates. A repeated row is a
    candidate each time and a query once. An empty table gives an empty result.
    """
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull() & finite(F.col("vec")) & F.exists("vec", lambda x: x != 0)
    )
    return search_tiles(
        rows, F.col("id") % query_step == 0, k, lambda ids, q: Int8Tile(ids, q, k), "double"
    )


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
