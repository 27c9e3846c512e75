"""Exact top-k search by term-at-a-time accumulation.

A query is a sparse row of (term, weight). A chunk of candidates is kept as postings by term: the rows
that have the term and their values. Term by term the weighted postings are scattered into dense score
arrays of the chunk's queries; then the k best per query are selected by partition and merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from servicelens.llm.common import read
from servicelens.llm.vectors import Searcher, finite, search_tiles

BEST = 5
QUERY_STEP = 50
FACTOR = 256

_MOST, _LEAST = (1 << 63) - 1, -(1 << 63)


def whole(vectors: np.ndarray, factor: int = FACTOR) -> np.ndarray:
    """floor(factor * x) as whole numbers; Python numbers where 64 bits could not hold a product."""
    floors = np.floor(vectors * factor)
    if np.abs(floors).max(initial=0.0) < 1 << 20:
        return floors.astype(np.int64)
    return np.array([[int(x) for x in row] for row in floors], object).reshape(floors.shape)


class TermTile(Searcher):
    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int = BEST, factor: int = FACTOR):
        self.ids, self.k, self.factor = query_ids, k, factor
        self.weights = whole(queries, factor)
        self.found: list[list[tuple[int, int]]] = [[] for _ in query_ids]

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        values = whole(vectors, self.factor)
        postings = [(rows := np.flatnonzero(values[:, t]), values[rows, t]) for t in range(values.shape[1])]
        step = max(1, (1 << 17) // len(ids))  # score arrays that stay in the cache
        kind = np.int64 if values.dtype == self.weights.dtype == np.int64 else object
        for at in range(0, len(self.ids), step):
            weights = self.weights[at : at + step]
            scores = np.zeros((len(ids), len(weights)), kind)
            for term, (rows, held) in enumerate(postings):
                users = np.flatnonzero(weights[:, term])
                if 2 * users.size > len(weights):  # the others add zero
                    scores[rows] += held[:, None] * weights[:, term]
                elif users.size:
                    scores[np.ix_(rows, users)] += held[:, None] * weights[users, term]
            if kind is object:
                scores = np.minimum(np.maximum(scores, _LEAST), _MOST)
            scores = np.ascontiguousarray(scores.T)
            own = self.ids[at : at + step, None] == ids
            for row in range(len(weights)):
                self._select(at + row, scores[row], ids, own[row])

    def _select(self, query: int, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        if own.any():
            scores, ids = scores[~own], ids[~own]
        if len(ids) > self.k:
            bound = np.partition(scores, len(ids) - self.k)[len(ids) - self.k]
            kept = np.flatnonzero(scores >= bound)  # with all that tie
            scores, ids = scores[kept], ids[kept]
            if len(ids) > self.k:
                ids, scores = (x[np.lexsort((ids, -scores))[: self.k]] for x in (ids, scores))
        merged = self.found[query] + [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True)]
        self.found[query] = sorted(merged)[: self.k]

    def best(self) -> Iterator[tuple[int, int, int]]:
        for row, found in enumerate(self.found):
            for score, other in found:
                yield row, other, -score


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = BEST,
    query_step: int = QUERY_STEP,
    factor: int = FACTOR,
) -> DataFrame:
    """The `k` highest whole-number products of every row whose id is divisible by `query_step`.

    Components become floor(factor * x) first. Returns query_id, rank, vec_id, score (long; a sum
    beyond its range counts as the nearest long); ties go to the smaller id. Null or empty vectors, such with null or
    non-finite components and rows without an id take no part; zero vectors do. Rows of another length
    than the query's are no candidates. A repeated row is a candidate each time and a query once. An
    empty table gives an empty result.
    """
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull() & finite(F.col("vec"))
    )
    return search_tiles(
        rows, F.col("id") % query_step == 0, k, lambda ids, q: TermTile(ids, q, k, factor), "long"
    )


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
