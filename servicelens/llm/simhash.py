"""Near duplicates by SimHash fingerprints and multi-index hashing.

Work is on distinct fingerprints, so copies cost one row. A fingerprint is cut into `SEGMENTS` segments
of equal width, each with a table of its own. Two fingerprints at distance `k` differ by at most
k // SEGMENTS bits in some segment, so for each segment a fingerprint looks up its own value and the
values in the small Hamming ball around it; complete distances are verified on what the tables return.
Of two values that differ by one bit, the one that has it as 0 looks for the other: each pair is met once.

Where a table entry holds many fingerprints, pairs are not written out: the entry is dealt to blocks of
bounded size, all distances within and between blocks are computed as arrays, and each block keeps
only the links that join its parts (a spanning forest). No link between components is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from servicelens.llm.common import map_arrow, read, sliced, stored, texts_of
from servicelens.llm.components import components

BITS = 64
DISTANCE = 3
SHINGLE = 3
SEED = 42
SEGMENTS = 2
WIDTH = BITS // SEGMENTS
#: Fingerprints of one table entry that a task compares with each other at a time.
BLOCK = 2048

#: Longer texts are worked through part by part.
PART_CHARS = 1 << 20

_SHINGLES = 1 << 16
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about `PART_CHARS`, cut at white space."""
    start = 0
    while len(text) - start > PART_CHARS and (space := _SPACE.search(text, start + PART_CHARS)):
        yield text[start : space.start()]
        start = space.start()
    yield text[start:]


def _add_bits(words: list[bytes], shingle: int, ones: np.ndarray) -> int:
    """Add the bits of the hashes of all shingles; returns the number of shingles."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(words) - shingle + 1
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _SHINGLES):
        stop = min(n, at + _SHINGLES)
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at:stop], ends[at:stop], strict=True)]
        octets = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return n


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text, as an unsigned number; no word: 0."""
    ones, n = np.zeros(BITS, np.int64), 0
    tail: list[bytes] = []  # words that shingles of the next part begin with
    seen = False
    for part in _parts(text):
        words = tail + part.encode().lower().split()  # bytes: lowers A-Z, splits at ASCII white space only
        seen = seen or bool(words)
        if len(words) >= shingle:
            n += _add_bits(words, shingle, ones)
            tail = words[len(words) - shingle + 1 :]
        else:
            tail = words
    if seen and not n:
        n = _add_bits(tail, len(tail), ones)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed 64-bit number; null texts count as empty."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = np.array([fingerprint(t, shingle) for t in texts_of(batch, "text")], np.uint64)
            yield pa.record_batch([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(narrow, compute, f"id {narrow.schema['id'].dataType.simpleString()}, fp long")


def _segment(fp: Column, s: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * s).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _entries(fps: DataFrame) -> DataFrame:
    """The tables: one row per fingerprint and segment."""
    keys = [F.struct(F.lit(s).alias("seg"), _segment(F.col("fp"), s).alias("key")) for s in range(SEGMENTS)]
    return fps.select("fp", F.inline(F.array(*keys)))


def _probes(fps: DataFrame) -> DataFrame:
    """Values one bit away from each segment, for the bits that are 0 in it."""
    bits = F.array(*[F.lit(1 << b).cast("long") for b in range(WIDTH)])

    def around(s: int) -> Column:
        value = _segment(F.col("fp"), s)
        unset = F.filter(bits, lambda b: value.bitwiseAND(b) == 0)
        return F.transform(unset, lambda b: F.struct(F.lit(s).alias("seg"), value.bitwiseOR(b).alias("key")))

    return fps.select("fp", F.inline(F.concat(*[around(s) for s in range(SEGMENTS)])))


class _Forest:
    """Links between positions of an array that join different parts."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def roots(self) -> np.ndarray:
        while True:
            further = self.parent[self.parent]
            if (further == self.parent).all():
                return self.parent
            self.parent = further

    def join(self, a: int, b: int) -> bool:
        parent = self.parent
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        if a == b:
            return False
        parent[max(a, b)] = min(a, b)
        return True


def _forest_links(left: np.ndarray, right: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph whose edges are near pairs of `left` x `right`."""
    both = np.concatenate([left, right])
    forest, links = _Forest(both.size), []
    for i in range(left.size):
        near = np.flatnonzero(np.bitwise_count((right ^ left[i]).view(np.uint64)) <= distance) + left.size
        roots = forest.roots()
        near = near[roots[near] != roots[i]]
        if near.size:
            _, first = np.unique(roots[near], return_index=True)
            for j in near[first].tolist():
                # the same fingerprint on both sides is one node and needs no link
                if forest.join(i, j) and both[j] != both[i]:
                    links.append((int(both[i]), int(both[j])))
    return links


def _dense_links(rows: DataFrame, distance: int) -> DataFrame:
    """Links within crowded entries. `rows`: seg, key, left and right block, fp, side (0 left, 1 right)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])
        waiting = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal waiting
            left = np.array(sides[0], np.int64)
            right = np.array(sides[1], np.int64)
            links = _forest_links(left, right, distance) if left.size and right.size else []
            sides[1].clear()
            waiting = 0
            if last:
                sides[0].clear()
            a = pa.array([min(x) for x in links], pa.int64())
            return pa.record_batch([a, pa.array([max(x) for x in links], pa.int64())], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("seg", "key", "lb", "rb", "side", "fp")]
            for seg, value, lb, rb, side, fp in zip(*columns, strict=True):
                if (seg, value, lb, rb) != key:
                    if key is not None:
                        yield flush(True)
                    key = (seg, value, lb, rb)
                sides[side].append(fp)
                waiting += side
                if waiting >= 4 * BLOCK:  # rows of the right side come last and are not kept
                    yield flush(False)
        if key is not None:
            yield flush(True)

    keys = ["seg", "key", "lb", "rb"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "side", "fp")
    return map_arrow(dealt.select(*keys, "side", "fp"), compare, "a long, b long")


def near_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) with a < b that connect all distinct fingerprints `fp` at most `distance` bits apart.

    Pairs that meet in a table entry of few fingerprints come as they are, crowded entries as forests.

    Tables and lookups are joined by sorting: Spark takes the lookups, some 32 rows for each fingerprint, for about
    as small as the stored fingerprints, and would send them all through the driver.
    """
    if distance // SEGMENTS > 1:
        raise ValueError(f"distances beyond {2 * SEGMENTS - 1} need more segments")
    entries = _entries(fps)
    table = entries.groupBy("seg", "key").agg(F.count("*").alias("n"), F.min("fp").alias("only"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("only"))) <= distance
    met = stored(_probes(fps).hint("merge").join(table.hint("merge"), ["seg", "key"]), "lookups")
    lonely = met.where((F.col("n") == 1) & near).select("fp", "only")
    few = lonely.select(F.least("fp", "only").alias("a"), F.greatest("fp", "only").alias("b"))

    blocks = F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    crowded = table.where(F.col("n") > 1).select("seg", "key", blocks)
    inside = entries.hint("merge").join(crowded.hint("merge"), ["seg", "key"]).withColumn(
        "own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    )
    outside = met.where(F.col("n") > 1).select("seg", "key", "fp", blocks)
    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    place = ["seg", "key", "fp"]
    # within an entry block i meets blocks i, i+1, ...; numbers from there on are for lookups
    as_left = inside.select(*place, F.explode(F.expr("sequence(own, blocks - 1)")).alias("rb"), "own")
    as_right = inside.select(*place, F.explode(F.expr("sequence(0, own)")).alias("lb"), "own")
    lookups = outside.select(*place, F.explode(all_blocks).alias("lb"))
    rows = (
        as_left.select(*place, F.col("own").alias("lb"), "rb", F.lit(0).alias("side"))
        .unionByName(as_right.select(*place, "lb", F.col("own").alias("rb"), F.lit(1).alias("side")))
        .unionByName(inside.select(*place, F.col("own").alias("lb"), F.lit(-1).alias("rb"), F.lit(0).alias("side")))
        .unionByName(lookups.select(*place, "lb", F.lit(-1).alias("rb"), F.lit(1).alias("side")))
    )
    return few.unionByName(_dense_links(rows, distance))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
) -> DataFrame:
    """One row per document: `id_col`, fingerprint (16 hex digits), component_id, the smallest id that
    links of at most `distance` differing bits reach.

    A null or empty text has fingerprint 0 and is linked like any other. A row with a null id belongs to
    its component but names none; a component of such rows only has a null name. Repeated rows come
    back as often as they are there, an empty table gives an empty result, other columns are not read.
    """
    found = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = found.groupBy("fp").agg(F.min("id").alias("first"))
    fps = stored(fps, "distinct-fingerprints")
    of = components(near_links(fps.select("fp"), distance))
    named = fps.join(of.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = named.join(names, "component").select("fp", "component_id")
    # every fingerprint has a class; a left join never sends the rows, which may be many in a small file, to the driver
    return found.join(classes, "fp", "left").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
