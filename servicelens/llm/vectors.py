"""Queries against all rows of a vector table, tile by tile.

Queries fall into groups of about `QUERY_ROWS` and candidates into groups of about `CANDIDATE_ROWS`;
each pair of groups is a tile that one task works through, the queries held, the candidates in chunks.
A tile returns its best per query, so what meets again is tiles times k rows per query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servicelens.llm.common import map_arrow

QUERY_ROWS = 2048
CANDIDATE_ROWS = 8192
CHUNK_ROWS = 4096
#: More candidate groups than this are not made; groups grow instead, so that merging stays small.
MOST_GROUPS = 1024

Tile = Callable[[np.ndarray, np.ndarray], "Searcher"]


class Searcher:
    """Holds the queries of a tile; `see` takes candidates, `best` gives (query row, id, score) at the end."""

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        raise NotImplementedError

    def best(self) -> Iterator[tuple[int, int, object]]:
        raise NotImplementedError


def finite(vec: Column) -> Column:
    """Not null, not empty, all components there and finite."""
    limit = F.lit(float("inf"))
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == limit))
    return F.coalesce((F.size(vec) > 0) & ~bad, F.lit(False))


def search_tiles(
    rows: DataFrame, is_query: Column, k: int, tile: Tile, score: str
) -> DataFrame:
    """`rows` (id long, vec array<double>), valid and without null ids; best `k` per query row.

    A row whose id is the query's own is no candidate for it. Rows of another length than the query's
    have no product with it and meet in no tile. Queries that share an id and a vector are one. The
    score is of type `score`; ties go to the smaller id. Returns query_id, rank, vec_id, score.
    """
    rows = rows.select("id", "vec", F.size("vec").alias("dim"))
    queries = rows.where(is_query).dropDuplicates(["id", "vec"])
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    groups = min(MOST_GROUPS, max(1, -(-sizes["n"] // CANDIDATE_ROWS)))
    query_groups = max(1, -(-sizes["q"] // QUERY_ROWS))
    spread = lambda n, seed: F.pmod(F.xxhash64("id", "vec", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = queries.select("dim", "id", "vec", F.lit(0).alias("side"), spread(query_groups, 1).alias("qg"))
    held = held.withColumn("cg", every(groups))
    # equal rows may be many: they are dealt out by chance of the row, not of its content
    mixed = F.pmod(F.monotonically_increasing_id() + F.xxhash64("id"), F.lit(groups)).cast("int")
    seen = rows.select("dim", "id", "vec", F.lit(1).alias("side"), mixed.alias("cg"))
    seen = seen.withColumn("qg", every(query_groups))
    keys = ["dim", "qg", "cg"]
    dealt = held.unionByName(seen).repartition(*keys).sortWithinPartitions(*keys, "side", "id")
    kind = pa.float64() if score == "double" else pa.int64()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, searcher, ids, vectors = None, None, [], []

        def result() -> pa.RecordBatch:
            found = list(searcher.best()) if searcher else []
            ids_, others, scores = zip(*found, strict=True) if found else ((), (), ())
            return pa.record_batch(
                [
                    pa.array([int(query_ids[i]) for i in ids_], pa.int64()),
                    pa.array([int(query_keys[i]) for i in ids_], pa.int64()),
                    pa.array([int(x) for x in others], pa.int64()),
                    pa.array([kind.to_pandas_dtype()(x) for x in scores], kind),
                ],
                ["query_id", "query_key", "vec_id", "score"],
            )

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "side", "id", "content")]
            dim, qg, cg, side, id_, content = columns
            vec = batch.column("vec")
            changes = np.flatnonzero(np.diff(np.stack([dim, qg, cg, side]), axis=1).any(axis=0)) + 1
            for a, b in zip(np.r_[0, changes], np.r_[changes, batch.num_rows], strict=True):
                now = (int(dim[a]), int(qg[a]), int(cg[a]))
                if now != key:
                    if searcher:
                        yield result()
                    key, searcher, ids, vectors = now, None, [], []
                part = vec.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, now[0])
                if side[a] == 0:
                    ids.append((id_[a:b], content[a:b]))
                    vectors.append(part)
                    continue
                if not ids:  # no query of this length in the group
                    continue
                if searcher is None:
                    query_ids, query_keys = (np.concatenate(x) for x in zip(*ids, strict=True))
                    searcher = tile(query_ids, np.concatenate(vectors))
                for at in range(a, b, CHUNK_ROWS):
                    stop = min(b, at + CHUNK_ROWS)
                    searcher.see(id_[at:stop], part[at - a : stop - a])
        if searcher:
            yield result()

    shown = dealt.withColumn("content", F.xxhash64("id", "vec")).select(*keys, "side", "id", "content", "vec")
    found = map_arrow(shown, work, f"query_id long, query_key long, vec_id long, score {score}")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
