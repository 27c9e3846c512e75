"""Near copies by similarity of word shingles: SimHash tables within groups, verified exactly.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked. Their fingerprints differ
by 10 bits on average, more than tables over all fingerprints can serve: those of 16 bits or fewer hold a share of the
corpus in each entry. So tables have a second key. A text takes part under the smallest of its shingles in `KEYS`
orders; similar texts have one of them in common with a probability of 1 - 0.2 ** KEYS at least, and other texts
seldom do. Within such a group fingerprints are cut into `SEGMENTS` segments, each with a table; each looks up the
values in the Hamming ball of radius 1 around its segments, which finds every pair up to `DISTANCE` bits apart.
Complete distances are verified, then the similarity on the shingles themselves.

Copies of one text are one row. A crowded group is dealt to pairs of blocks; each task returns the links that join
its parts, so no group becomes all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servicelens.llm.common import map_arrow, sliced, stored, texts_of
from servicelens.llm.components import components
from servicelens.llm.simhash import SEED, _Forest, _parts

SHINGLE = 5
SIMILARITY = 0.8
BITS, SEGMENTS = 64, 8
WIDTH = BITS // SEGMENTS
#: Pairs this near are met for certain: they differ by one bit or none in some segment.
DISTANCE = 2 * SEGMENTS - 1
KEYS = 3
#: Texts of a group that a task compares with each other at a time.
BLOCK = 1024

_ORDERS = np.array([xxhash.xxh64_intdigest(b"order", seed) | 1 for seed in range(KEYS)], np.uint64)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The different hashes of a text's word shingles, sorted; a text of fewer words is one shingle."""
    found, tail = [], []
    digest = xxhash.xxh64_intdigest
    for part in _parts(text):
        words = tail + part.encode().lower().split()  # bytes: lowers A-Z, splits at ASCII white space only
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.r_[0, ends[:-1] + 1]
            n = len(words) - size + 1
            spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
            found.append(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n))
            tail = words[n:]
        else:
            tail = words
    if not found and tail:
        found.append(np.array([digest(b" ".join(tail), SEED)], np.uint64))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; signed."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        octets = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def smallest(hashes: np.ndarray) -> list[int]:
    """The smallest hash in each order, as what it is there; signed."""
    least = []
    for order in _ORDERS:
        mixed = (hashes ^ (hashes >> np.uint64(31))) * order
        least.append(int((mixed ^ (mixed >> np.uint64(29))).min().astype(np.int64)))
    return least


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard's, of sorted arrays of different values; 1 for two empty ones."""
    both = np.intersect1d(a, b, assume_unique=True).size
    every = a.size + b.size - both
    return both / every if every else 1.0


def near_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, distance) of all pairs of fingerprints up to `DISTANCE` bits apart, by segment tables."""
    mask = np.uint64((1 << WIDTH) - 1)
    balls = np.array([0, *(1 << b for b in range(WIDTH))], np.uint64)
    pairs = []
    for s in range(SEGMENTS):
        shift = np.uint64(WIDTH * s)
        table = (right >> shift) & mask
        order = np.argsort(table, kind="stable")
        held = table[order]
        wanted = ((left >> shift) & mask)[:, None] ^ balls
        first = np.searchsorted(held, wanted.ravel(), side="left")
        sizes = np.searchsorted(held, wanted.ravel(), side="right") - first
        rows = np.repeat(np.repeat(np.arange(len(left)), len(balls)), sizes)
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        columns = order[np.repeat(first, sizes) + within]
        near = np.bitwise_count(left[rows] ^ right[columns]) <= DISTANCE
        pairs.append(rows[near] * len(right) + columns[near])
    met = np.unique(np.concatenate(pairs))
    rows, columns = met // max(1, len(right)), met % max(1, len(right))
    return rows, columns, np.bitwise_count(left[rows] ^ right[columns])


class _Side:
    """Texts of a block: nodes, fingerprints and shingles."""

    def __init__(self, rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows)
        self.nodes = np.stack([table[c].to_numpy() for c in ("t0", "t1")], axis=1)
        self.prints = table["fp"].to_numpy().view(np.uint64)
        self.shingles = [np.frombuffer(x, "<u4") for x in table["shingles"].to_pylist()]
        self.sizes = np.array([x.size for x in self.shingles])


def verified_links(left: _Side, right: _Side, least: float) -> list[tuple[int, int]]:
    """Pairs of `least` similarity that join the parts of a block pair, nearest first: (left, right) rows."""
    rows, columns, apart = near_pairs(left.prints, right.prints)
    a, b = left.sizes[rows], right.sizes[columns]
    fits = np.minimum(a, b) >= least * np.maximum(a, b)
    fits &= (left.nodes[rows] != right.nodes[columns]).any(axis=1)
    rows, columns, apart = rows[fits], columns[fits], apart[fits]
    order = np.argsort(apart, kind="stable")
    # the same text on both sides is one node
    names: dict[tuple[int, int], int] = {}
    number = lambda side: [names.setdefault(tuple(n), len(names)) for n in side.nodes.tolist()]
    of_left, of_right = number(left), number(right)
    forest, links = _Forest(len(names)), []
    parent = forest.parent.tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in zip(rows[order].tolist(), columns[order].tolist(), strict=True):
        x, y = root(of_left[i]), root(of_right[j])
        if x != y and similarity(left.shingles[i], right.shingles[j]) >= least:
            parent[max(x, y)] = min(x, y)
            links.append((i, j))
    return links


def _compared(rows: DataFrame, least: float) -> DataFrame:
    """(a0, a1, b0, b1): links between texts. rows: key, lb, rb, side (0 left, 1 right), t0, t1, fp, shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sides = None, ([], [])

        def flush() -> pa.RecordBatch:
            found = []
            if sides[0]:
                left = _Side(sides[0])
                right = _Side(sides[1]) if sides[1] else left
                links = verified_links(left, right, least)
                found = [(*left.nodes[i], *right.nodes[j]) for i, j in links]
            for side in sides:
                side.clear()
            columns = zip(*found, strict=True) if found else [()] * 4
            return pa.record_batch([pa.array(list(map(int, c)), pa.int64()) for c in columns], ["a0", "a1", "b0", "b1"])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lb", "rb", "side")]
            changes = np.flatnonzero(np.diff(np.stack(columns), axis=1).any(axis=0)) + 1
            for start, stop in zip(np.r_[0, changes], np.r_[changes, batch.num_rows], strict=True):
                now = tuple(int(c[start]) for c in columns[:3])
                if now != place:
                    if place is not None:
                        yield flush()
                    place = now
                sides[int(columns[3][start])].append(batch.slice(start, stop - start))
        if place is not None:
            yield flush()

    keys = ["key", "lb", "rb"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "side")
    return map_arrow(dealt.select(*keys, "side", "t0", "t1", "fp", "shingles"), work, "a0 long, a1 long, b0 long, b1 long")


def _text_key(text: Column) -> list[Column]:
    """128 bits of a text; null counts as empty."""
    given = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(given).alias("t0"), F.xxhash64(given, F.lit(1)).alias("t1")]


def _sketched(texts: DataFrame) -> DataFrame:
    """(t0, t1, size, fp, keys) of texts (t0, t1, text): shingles are counted, the rest is made of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = [shingles(t) for t in texts_of(batch, "text")]
            yield pa.record_batch(
                [
                    batch.column("t0"),
                    batch.column("t1"),
                    pa.array([x.size for x in found], pa.int64()),
                    pa.array([fingerprint(x) for x in found], pa.int64()),
                    # texts without words are one group
                    pa.array([smallest(x) if x.size else [0] for x in found], pa.list_(pa.int64())),
                ],
                ["t0", "t1", "size", "fp", "keys"],
            )

    return map_arrow(texts, work, "t0 long, t1 long, size long, fp long, keys array<long>")


def _with_shingles(texts: DataFrame) -> DataFrame:
    """(t0, t1, shingles) of texts (t0, t1, text): the upper halves of the hashes, sorted, as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            halves = [np.unique((shingles(t) >> np.uint64(32)).astype("<u4")).tobytes() for t in texts_of(batch, "text")]
            yield pa.record_batch([batch.column("t0"), batch.column("t1"), pa.array(halves, pa.binary())], ["t0", "t1", "shingles"])

    return map_arrow(texts, work, "t0 long, t1 long, shingles binary")


def near_copy_links(docs: DataFrame, text_col: str, least: float = SIMILARITY) -> DataFrame:
    """(a0, a1, b0, b1): links between different texts of `least` similarity that connect all that were found."""
    keyed = docs.select(*_text_key(F.col(text_col)), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sketches = stored(_sketched(keyed), "sketches").distinct()
    entries = sketches.select("t0", "t1", "fp", F.explode("keys").alias("key")).distinct()
    entries = stored(entries, "sketch-entries")
    counts = entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    shared = entries.join(counts, "key").select(
        "key", "t0", "t1", "fp", blocks.alias("blocks"), F.pmod(F.col("t1"), blocks).cast("int").alias("own")
    )
    shared = stored(shared, "shared-entries")
    wanted = shared.select("t0", "t1").distinct()
    texts = keyed.join(wanted, ["t0", "t1"], "left_semi").dropDuplicates(["t0", "t1"])
    held = _with_shingles(texts)
    # block i of a group meets blocks i, i + 1, ...; within a block the left side is also the right one
    left = shared.withColumn("rb", F.explode(F.expr("sequence(own, blocks - 1)"))).withColumn("lb", F.col("own"))
    right = shared.where(F.col("own") > 0).withColumn("lb", F.explode(F.expr("sequence(0, own - 1)"))).withColumn("rb", F.col("own"))
    sides = [df.select("key", "lb", "rb", "t0", "t1", "fp", F.lit(s).alias("side")) for s, df in enumerate((left, right))]
    rows = sides[0].unionByName(sides[1]).join(held, ["t0", "t1"])
    return _compared(rows, least)


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY
) -> DataFrame:
    """(id_col, component_id): one row per document; component_id is the smallest id that links reach.

    Texts are linked if the Jaccard similarity of their sets of five-word shingles is `least` or more; words are
    lower-cased (A-Z) and end at ASCII white space. A text of fewer words is one shingle; texts without words, null
    ones included, are all linked. A row without an id belongs to its component but names none. Repeated rows come
    back as often as they are there, an empty table gives an empty result, other columns are not read.

    Not every such pair is met: at a similarity of 0.8 about 97 of 100 are, more above it; what is met is right.
    """
    links = stored(near_copy_links(docs, text_col, least), "near-links")
    node = lambda c: F.struct(F.col(f"{c}0").alias("t0"), F.col(f"{c}1").alias("t1")).alias(c)
    of = components(links.select(node("a"), node("b")))
    of = of.select(F.col("node.t0").alias("t0"), F.col("node.t1").alias("t1"), "component")
    rows = docs.select(F.col(id_col).alias("id"), *_text_key(F.col(text_col)))
    firsts = rows.groupBy("t0", "t1").agg(F.min("id").alias("first"))
    own = F.struct("t0", "t1")
    named = firsts.join(of, ["t0", "t1"], "left").withColumn("component", F.coalesce("component", own))
    named = stored(named, "near-classes")
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = named.join(names, "component").select("t0", "t1", "component_id")
    return rows.join(classes, ["t0", "t1"]).select(F.col("id").alias(id_col), "component_id")
