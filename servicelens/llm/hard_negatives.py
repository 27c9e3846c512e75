"""Hard negatives by threshold joins over an inverted index with norm bounds.

A window asks for the best `k` rows of an anchor whose score lies between two bounds. A join at a threshold
finds every row that reaches it. Thresholds start high and are lowered until the window is full or its lower
bound is reached, so most joins see few survivors.

A join works on tiles of anchors and candidates. Dimensions come in blocks, those of most energy first. The
inverted index of a block lists the candidates whose norm from that block on, times the anchors', still
reaches the threshold; the trailing blocks of a vector, which cannot lift any pair to it alone, are left out.
Partial scores are accumulated over the lists, a candidate is dropped when its partial scores and the remaining
norms reach no threshold, and what survives is scored on all dimensions in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from servicelens.llm.common import map_arrow, read, stored
from servicelens.llm.vectors import finite

ANCHOR_STEP = 100
POSITIVES = 5
NEGATIVES = 10
#: A negative scores from 30 to 90 hundredths of the positive's score.
LOW, HIGH = 30, 90
FACTOR = 256

#: Thresholds of a window as shares of the way from its upper to its lower bound; the last reaches it.
STEPS = (0.35, 0.7, 1.0)
#: Thresholds of the search for positives as shares of the anchor's squared norm; the last knows no threshold.
SHARES = (0.45, 0.2, None)

#: Sizes of tiles. They bound what a task holds and change no result.
ANCHOR_ROWS = 16384
CANDIDATE_ROWS = 8192
CHUNK_ROWS = 4096
MOST_GROUPS = 4096
BLOCK_DIMS = 8
_PAIRS = 1 << 19

_MOST, _LEAST = (1 << 63) - 1, -(1 << 63)
#: Whole numbers up to here are exact in double precision.
_EXACT = float(1 << 52)


def _packed(rows: DataFrame, factor: int) -> DataFrame:
    """`vec` becomes codes, floor(factor * x) as 16-bit numbers, of large vectors as doubles (also whole), and
    squares, the sum of their squares.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec")
            floors = np.floor(vec.flatten().to_numpy(zero_copy_only=False) * factor)
            ends = np.cumsum(batch.column("dim").to_numpy())
            codes, squares = [], []
            for part in np.split(floors, ends[:-1]) if len(ends) else []:
                small = np.abs(part).max(initial=0.0) < 1 << 15
                codes.append(part.astype("<i2" if small else "<f8").tobytes())
                with np.errstate(over="ignore"):
                    squares.append(float(np.square(part).sum()))
            columns = [batch.column(c) for c in ("id", "label", "dim")]
            columns += [pa.array(codes, pa.binary()), pa.array(squares, pa.float64())]
            yield pa.record_batch(columns, ["id", "label", "dim", "codes", "squares"])

    return map_arrow(rows, work, "id long, label long, dim int, codes binary, squares double")


def _unpacked(codes: list[bytes], dim: int) -> np.ndarray:
    if all(len(c) == 2 * dim for c in codes):
        return np.frombuffer(b"".join(codes), "<i2").reshape(len(codes), dim).astype(np.float64)
    return np.stack([np.frombuffer(c, "<i2" if len(c) == 2 * dim else "<f8").astype(np.float64) for c in codes])


def _tails(x: np.ndarray, starts: range) -> np.ndarray:
    """Norms of the rows from each start on, and 0 after the last; rounded up."""
    squares = np.cumsum(np.square(x)[:, ::-1], axis=1)[:, ::-1]
    tails = np.sqrt(squares[:, list(starts)]) * (1 + 1e-9)
    return np.concatenate([tails, np.zeros((len(x), 1))], axis=1)


class WindowTile:
    """Windows of some anchors; `see` takes candidates, `best` gives (window, id, score) at the end.

    anchors: (a, d) whole numbers as doubles; low, high: (a, slots) bounds of the windows, a slot that is not
    used has low > high. `same` asks for candidates of the anchor's label, else for those of other labels.
    """

    def __init__(self, ids, labels, anchors, low, high, k: int, same: bool):
        self.ids, self.labels, self.anchors = ids, labels, anchors
        self.low, self.high, self.k, self.same = low, high, k, same
        used = low <= high
        self.least = np.where(used, low, _MOST).min(axis=1)
        self.most = np.where(used, high, _LEAST).max(axis=1)
        self.norms = np.sqrt(np.square(anchors).sum(axis=1)) if len(anchors) else np.zeros(0)
        empty = np.zeros(0, np.int64)
        self.found = [(empty, empty, empty) for _ in range(low.shape[1])]  # anchor, score, id by slot
        self.scored = 0  # pairs scored on all dimensions

    def see(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            norms = np.sqrt(np.square(vectors).sum(axis=1))
            exact = norms * self.norms.max(initial=0.0) < _EXACT
        if not exact.all():
            self._see_large(ids[~exact], labels[~exact], vectors[~exact])
            ids, labels, vectors = ids[exact], labels[exact], vectors[exact]
        if not len(ids):
            return
        order = np.argsort(-np.square(vectors).sum(axis=0), kind="stable")
        theirs = np.ascontiguousarray(vectors[:, order])
        starts = range(0, theirs.shape[1], BLOCK_DIMS)
        tails = _tails(theirs, starts)
        step = max(1, _PAIRS // len(ids))
        for at in range(0, len(self.ids), step):
            part = slice(at, at + step)
            mine = np.ascontiguousarray(self.anchors[part][:, order])
            rows, columns = self._survivors(mine, theirs, tails, starts, self.least[part], self.most[part])
            self.scored += rows.size
            for i in range(0, rows.size, _PAIRS):
                r, c = rows[i : i + _PAIRS], columns[i : i + _PAIRS]
                scores = np.einsum("ij,ij->i", theirs[r], mine[c]).astype(np.int64)
                self._take(c + at, scores, ids[r], labels[r])

    def _survivors(self, mine, theirs, tails, starts, least, most):
        """(candidate rows, anchor rows) of the pairs that may lie between the bounds."""
        own = _tails(mine, starts)
        least = least.astype(np.float64) - 0.5  # whole numbers: nothing is lost, and rounding does no harm
        most = most.astype(np.float64) + 0.5
        partial = np.zeros((len(theirs), len(mine)))
        alive = np.ones(len(theirs), bool)
        indexed = np.zeros(len(theirs), np.int64)  # blocks of each row that the index holds
        for b, start in enumerate(starts):
            with np.errstate(divide="ignore", invalid="ignore"):
                cover = np.where(least > 0, least / own[:, b], 0.0).min(initial=np.inf)
            posted = np.flatnonzero(alive & (tails[:, b] >= cover))  # the inverted list of the block
            if not posted.size:
                break
            indexed[posted] = b + 1
            left = tails[posted, b][:, None] * own[:, b]
            hope = (partial[posted] + left >= least) & (partial[posted] - left <= most)
            held = hope.any(axis=1)
            alive[posted[~held]] = False
            posted = posted[held]
            dims = slice(start, start + BLOCK_DIMS)
            partial[posted] += theirs[posted, dims] @ mine[:, dims].T
        alive = np.flatnonzero(alive & (indexed > 0))  # the others share no list with an anchor
        rest = indexed[alive]
        left = tails[alive, rest][:, None] * own[:, rest].T
        rows, columns = np.nonzero((partial[alive] + left >= least) & (partial[alive] - left <= most))
        return alive[rows], columns

    def _see_large(self, ids, labels, vectors) -> None:
        """Vectors whose products doubles cannot hold: whole numbers of any size, all pairs of a chunk."""
        whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
        theirs = whole(vectors)
        step = max(1, _PAIRS // max(1, len(ids)))
        for at in range(0, len(self.ids), step):
            mine = whole(self.anchors[at : at + step])
            scores = np.minimum(np.maximum(theirs.dot(mine.T), _LEAST), _MOST).astype(np.int64)
            rows, columns = (x.ravel() for x in np.indices(scores.shape))
            self._take(columns + at, scores.ravel(), ids[rows], labels[rows])

    def _take(self, anchors, scores, ids, labels) -> None:
        fits = (labels == self.labels[anchors]) == self.same
        fits &= ids != self.ids[anchors]
        anchors, scores, ids = anchors[fits], scores[fits], ids[fits]
        for slot, held in enumerate(self.found):
            inside = (scores >= self.low[anchors, slot]) & (scores <= self.high[anchors, slot])
            if inside.any():
                new = (anchors[inside], scores[inside], ids[inside])
                self.found[slot] = self._first(*map(np.concatenate, zip(held, new, strict=True)))

    def _first(self, anchors, scores, ids):
        """The first `k` of each anchor, by score, then id."""
        order = np.lexsort((ids, ~scores, anchors))
        anchors, scores, ids = anchors[order], scores[order], ids[order]
        place = np.arange(len(anchors)) - np.searchsorted(anchors, anchors)
        kept = place < self.k
        return anchors[kept], scores[kept], ids[kept]

    def best(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for slot, (anchors, scores, ids) in enumerate(self.found):
            yield slot, anchors, scores, ids


def _bounds(windows: list[list[dict]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, low, high) of the windows of each anchor, as arrays of as many columns as the most have."""
    shape = (len(windows), max(map(len, windows), default=0))
    slots, low, high = np.zeros(shape, np.int32), np.full(shape, _MOST), np.full(shape, _LEAST)
    for row, listed in enumerate(windows):
        for i, window in enumerate(listed):
            slots[row, i], low[row, i], high[row, i] = window["slot"], window["low"], window["high"]
    return slots, low, high


def _join(
    anchors: DataFrame, windows: DataFrame, rows: DataFrame, k: int, same: bool, groups: int, anchor_groups: int
) -> DataFrame:
    """(key, slot, id, score): the first `k` rows of every window and candidate group."""
    listed = windows.groupBy("key").agg(F.collect_list(F.struct("slot", "low", "high")).alias("windows"))
    asked = anchors.join(listed, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = asked.select(
        "dim",
        F.pmod(F.xxhash64("key"), F.lit(anchor_groups)).cast("int").alias("ag"),
        every(groups).alias("cg"),
        F.lit(0).alias("side"),
        *["key", "id", "label", "codes", "windows"],
    )
    nothing = [F.lit(None).cast(held.schema[c].dataType).alias(c) for c in ("key", "windows")]
    seen = rows.select(
        "dim", every(anchor_groups).alias("ag"), "cg", F.lit(1).alias("side"), nothing[0], "id", "label", "codes", nothing[1]
    )
    keys = ["dim", "ag", "cg"]
    dealt = held.unionByName(seen).repartition(*keys).sortWithinPartitions(*keys, "side")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, tile, numbers, slots = None, None, None, None
        waiting: list[pa.RecordBatch] = []

        def result() -> Iterator[pa.RecordBatch]:
            for column, anchor, score, id_ in tile.best() if tile else ():
                found = (numbers[anchor], slots[anchor, column], id_, score)
                yield pa.record_batch([pa.array(x) for x in found], ["key", "slot", "id", "score"])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "side")]
            changes = np.flatnonzero(np.diff(np.stack(columns), axis=1).any(axis=0)) + 1
            for a, b in zip(np.r_[0, changes], np.r_[changes, batch.num_rows], strict=True):
                now = tuple(int(c[a]) for c in columns[:3])
                if now != place:
                    yield from result()
                    place, tile = now, None
                    waiting.clear()
                part = batch.slice(a, b - a)
                if columns[3][a] == 0:
                    waiting.append(part)
                    continue
                if tile is None:
                    if not waiting:  # no anchor of this length in the group
                        continue
                    table = pa.Table.from_batches(waiting)
                    numbers = table["key"].to_numpy()
                    slots, low, high = _bounds(table["windows"].to_pylist())
                    vectors = _unpacked(table["codes"].to_pylist(), place[0])
                    tile = WindowTile(table["id"].to_numpy(), table["label"].to_numpy(), vectors, low, high, k, same)
                    waiting.clear()
                for at in range(0, part.num_rows, CHUNK_ROWS):
                    chunk = part.slice(at, CHUNK_ROWS)
                    vectors = _unpacked(chunk.column("codes").to_pylist(), place[0])
                    tile.see(chunk.column("id").to_numpy(), chunk.column("label").to_numpy(), vectors)
        yield from result()

    return map_arrow(dealt, work, "key long, slot int, id long, score long")


def fill_windows(
    anchors: DataFrame,
    windows: DataFrame,
    rows: DataFrame,
    k: int,
    same: bool,
    thresholds: list[Column],
    groups: int,
) -> DataFrame:
    """(key, slot, rank, id, score): the first `k` rows of every window, by joins at falling thresholds.

    anchors: key, id, label, dim, codes; windows: key, slot, low, high and what `thresholds` read; rows: id,
    label, dim, codes, cg. A window that a join fills is done, as the join has seen every row that reaches its
    threshold. The others go on to the next threshold, the last of which must be their lower bound.
    """
    order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "id")
    anchor_groups = max(1, -(-anchors.count() // ANCHOR_ROWS))
    left = windows.where(F.col("low") <= F.col("high"))
    found, still = None, left.count()
    for threshold in thresholds:
        asked = left.select("key", "slot", F.greatest("low", threshold).alias("low"), "high")
        asked = asked.where(F.col("low") <= F.col("high"))
        hits = _join(anchors, asked, rows, k, same, groups, anchor_groups)
        hits = stored(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "window-hits")
        if threshold is thresholds[-1]:
            return hits if found is None else found.unionByName(hits)
        full = hits.where(F.col("rank") == k).select("key", "slot")
        done = hits.join(full, ["key", "slot"], "left_semi")
        found = done if found is None else found.unionByName(done)
        still -= full.count()
        if not still:
            break
        left = left.join(full, ["key", "slot"], "left_anti")
    return found


def _grouped(rows: DataFrame) -> tuple[DataFrame, int]:
    """`rows` dealt to candidate groups by chance of the row, not of its content, and their number."""
    groups = min(MOST_GROUPS, max(1, -(-rows.count() // CANDIDATE_ROWS)))
    mixed = F.pmod(F.monotonically_increasing_id() + F.xxhash64("id"), F.lit(groups)).cast("int")
    return rows.withColumn("cg", mixed), groups


def _whole(x: Column) -> Column:
    """A double as a long, the nearest one if it is out of range."""
    return F.least(F.greatest(x, F.lit(-9.2e18)), F.lit(9.2e18)).cast("long")


def _bound(score: Column, share: int, up: bool) -> Column:
    """share/100 of a score, to the whole number within the window."""
    exact = score.cast("decimal(20,0)") * F.lit(share).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")
    return (F.ceil(exact) if up else F.floor(exact)).cast("long")


def hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    anchor_step: int = ANCHOR_STEP,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    factor: int = FACTOR,
) -> DataFrame:
    """Hard negatives of every row whose id is divisible by `anchor_step`.

    Scores are products of floor(factor * x), whole numbers; a sum beyond the range of long counts as the
    nearest long. An anchor's positives are the first `positives` other rows of its label by score, then id.
    For each of them come the first `negatives` rows of other labels whose score is from `low` to `high`
    hundredths of the positive's. Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score; a positive without such rows has none.

    Labels are whole numbers. Rows without an id, label or vector, with an empty vector or one with a component
    that is null, not finite or beyond doubles once multiplied take no part. Rows of another length than the
    anchor's have no score with it. Rows that share the anchor's id are the anchor itself; an anchor that is
    repeated in all columns is asked once. Other repeated rows count each time. An empty table gives an empty
    result; other columns are not read.
    """
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec")
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.transform("vec", lambda x: x * factor)))
    rows = rows.withColumn("dim", F.size("vec"))
    rows = stored(_packed(rows.select("id", "label", "dim", "vec"), factor), "vector-codes")
    rows, groups = _grouped(rows)
    asked = ["id", "label", "dim", "codes", "squares"]
    anchors = rows.where(F.col("id") % anchor_step == 0).select(*asked).distinct()
    anchors = stored(anchors.withColumn("key", F.monotonically_increasing_id()), "anchors")

    everything = anchors.select(
        "key", "squares", F.lit(0).alias("slot"), F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high")
    )
    shares = [F.col("low") if s is None else _whole(F.col("squares") * s) for s in SHARES]
    near = fill_windows(anchors, everything, rows, positives, True, shares, groups)
    near = stored(
        near.select("key", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives"
    )

    windows = near.select(
        "key",
        F.col("rank").alias("slot"),
        _bound(F.col("positive_score"), low, True).alias("low"),
        _bound(F.col("positive_score"), high, False).alias("high"),
    )
    span = F.col("high").cast("double") - F.col("low").cast("double")
    steps = [F.col("low") if s == 1 else _whole(F.col("high").cast("double") - span * s) for s in STEPS]
    far = fill_windows(anchors, windows, rows, negatives, False, steps, groups)
    far = far.select("key", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.withColumnRenamed("rank", "slot").join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    return near.join(far, ["key", "slot"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM scored WHERE same)
  WHERE r <= 5
), ranked AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored s USING (anchor_id)
  WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
