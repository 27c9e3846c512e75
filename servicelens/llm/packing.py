"""Packing of token sequences: dominance reduction after Martello and Toth, then best fit.

Only lengths matter for packing and there are at most `capacity` of them, so the instance is the
histogram of lengths: Spark counts it, the plan is made from these few numbers, and Spark applies it
to the pieces. A plan consists of runs: so many pieces of one length, from a rank on, go to
consecutive sequences at one offset. Ranks within a length are dealt out by hash bucket, so a length
that a third of all pieces share is ranked by many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from servicelens.llm.byte_bpe import ByteVocabulary
from servicelens.llm.common import SLICE_CHARS, WordCache, map_arrow, read, sliced, stored, texts_of

CAPACITY = 1024
END_ID = 2
#: Pieces that one task ranks, on average.
BUCKET_ROWS = 50_000

#: Words that a Python worker remembers.
WORDS = 200_000

_RANK_BITS = 40
_loaded: dict[str, tuple[ByteVocabulary, WordCache]] = {}


class Run(NamedTuple):
    """Pieces of `length` with ranks from `rank` on, `count` of them, go to sequences from `sequence` on."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int


class _Plan:
    def __init__(self, counts: np.ndarray, capacity: int):
        self.left = [int(c) for c in counts]
        self.used = [0] * len(counts)
        self.capacity, self.sequences, self.runs = capacity, 0, []

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append(Run(length, self.used[length], count, sequence, offset))
        self.used[length] += count
        self.left[length] -= count

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def smallest(self, without: int) -> list[int]:
        """The three smallest lengths left, one piece of `without` aside, with repetitions."""
        found: list[int] = []
        for length in range(1, self.capacity + 1):
            n = min(self.left[length] - (length == without), 3 - len(found))
            found += [length] * n
            if len(found) == 3:
                break
        return found

    def largest(self, most: int, without: int) -> int:
        for length in range(most, 0, -1):
            if self.left[length] - (length == without) > 0:
                return length
        return 0

    def best_pair(self, most: int, without: int) -> int:
        """The largest sum of two pieces that is at most `most`, one piece of `without` aside."""
        have = {x: n for x in range(1, most) if (n := self.left[x] - (x == without)) > 0}
        sizes, best = sorted(have), 0
        low, high = 0, len(sizes) - 1
        while low <= high:
            a, b = sizes[low], sizes[high]
            if a + b > most or (low == high and have[a] < 2):
                high -= 1
            else:
                best, low = max(best, a + b), low + 1
        return best

    def dominating(self, length: int) -> int | None:
        """A partner that dominates every other way to fill the sequence of a piece; 0 is none, None unknown.

        {length, t} dominates when t fills the sequence, or when whatever else fits beside `length`
        fits in the place of t: t is the largest that fits and no two others together are larger.
        """
        room = self.capacity - length
        small = self.smallest(length)
        if not small or small[0] > room:
            return 0
        partner = self.largest(room, length)
        if partner == room or len(small) < 2 or small[0] + small[1] > room:
            return partner
        if (len(small) < 3 or sum(small) > room) and self.best_pair(room, length) <= partner:
            return partner
        return None

    def reduce(self) -> int:
        """Fix dominating sets for good until no piece has one; returns the sequences fixed."""
        changed = True
        while changed:
            changed = False
            for length in range(self.capacity, 0, -1):
                while self.left[length] and (partner := self.dominating(length)) is not None:
                    changed = True
                    if not partner:
                        n = self.left[length]
                        self.place(length, n, self.open(n), 0)
                        continue
                    n = self.left[length] // 2 if partner == length else min(self.left[length], self.left[partner])
                    first = self.open(n)
                    self.place(length, n, first, 0)
                    self.place(partner, n, first, length)
        return self.sequences

    def best_fit(self) -> None:
        """Place what is left, longest first, each in the fullest sequence that holds it."""
        rooms: list[list[tuple[int, int]]] = [[] for _ in range(self.capacity + 1)]

        def fill(length: int, room: int, first: int, count: int) -> None:
            """Fill `count` sequences of equal room as far as pieces of `length` go."""
            each = room // length
            full = min(count, self.left[length] // each)
            if full:
                for k in range(each):
                    self.place(length, full, first, self.capacity - room + k * length)
                rooms[room - each * length].append((first, full))
            if full < count:
                rest = self.left[length]
                for k in range(rest):
                    self.place(length, 1, first + full, self.capacity - room + k * length)
                rooms[room - rest * length].append((first + full, 1))
                if full + 1 < count:
                    rooms[room].append((first + full + 1, count - full - 1))

        for length in range(self.capacity, 0, -1):
            for room in range(length, self.capacity):
                while rooms[room] and self.left[length]:
                    first, count = rooms[room].pop()
                    fill(length, room, first, count)
            if self.left[length]:
                n = -(-self.left[length] // (self.capacity // length))
                fill(length, self.capacity, self.open(n), n)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[Run], int, int]:
    """Runs for a histogram `counts[length]`, the number of sequences, and how many the reduction fixed."""
    made = _Plan(counts, capacity)
    fixed = made.reduce()
    made.best_fit()
    return made.runs, made.sequences, fixed


def encoder(path: str) -> tuple[ByteVocabulary, WordCache]:
    """The vocabulary and the ids of words seen so far, once for each Python worker."""
    if path not in _loaded:
        _loaded[path] = ByteVocabulary(path), WordCache(WORDS)
    return _loaded[path]


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers, those of the `tokenizers` library."""
    vocabulary, cache = encoder(path)
    found: list[list[bytes]] = [[] for _ in texts]

    def add(held: list[tuple[int, list[str], str]]) -> None:
        used = set().union(*[words for _, words, _ in held])
        cache.shrink(used)
        if new := cache.missing(used):
            ids, counts = vocabulary.merger.encode([w.encode() for w in new])
            codes, ends = ids.astype("<u4").tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
            cache.update(zip(new, map(codes.__getitem__, map(slice, ends, ends[1:])), strict=True))
        for i, words, special in held:
            found[i].append(b"".join(map(cache.__getitem__, words)))
            if special:
                found[i].append(np.array([vocabulary.special_ids[special]], "<u4").tobytes())

    held: list[tuple[int, list[str], str]] = []
    chars = 0
    for i, text in enumerate(texts):
        for part, special in vocabulary.parts(text):
            held.append((i, vocabulary.words(part), special))
            chars += len(part)
            if chars >= SLICE_CHARS // 2:
                add(held)
                held, chars = [], 0
    add(held)
    return [b"".join(codes) for codes in found]


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Ids of each document and `end_id`, cut where they exceed `capacity`; the first piece takes the rest.

    Columns: `id_col`, piece, start, length, ids_crc32 and, on request, ids (array of int).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in sliced(batches, "text"):
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, code in enumerate(encode_texts(texts_of(batch, "text"), tokenizer)):
                code += end
                n = len(code) // 4
                stops = range((n - 1) % capacity + 1, n + 1, capacity)
                for k, stop in enumerate(stops):
                    begin = max(0, stop - capacity) if k else 0
                    part = code[4 * begin : 4 * stop]
                    rows.append(i)
                    piece.append(k)
                    start.append(begin)
                    length.append(stop - begin)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            columns = [
                batch.column("id").take(pa.array(rows, pa.int32())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.record_batch(columns, names)
        # idle workers wait beside the tasks that sort and write: they hold no words
        encoder(tokenizer)[1].clear()

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    return map_arrow(narrow, cut, schema + ", ids array<int>" * with_ids).withColumnRenamed("id", id_col)


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """Add sequence_id and offset to rows that have a length of 1 to `capacity`.

    `pieces` is read three times and should be a stored table. Equal rows are placed one by one, an
    empty table gives an empty result. At most `capacity` numbers come to the driver.
    """
    lengths = pieces.groupBy(F.col(length_col).alias("length")).count().collect()
    counts = np.zeros(capacity + 1, np.int64)
    for row in lengths:
        if not row["length"] or not 0 < row["length"] <= capacity:
            raise ValueError(f"a piece of length {row['length']} does not fit a sequence of {capacity}")
        counts[row["length"]] = row["count"]
    runs, _, _ = plan(counts, capacity)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    keys = (table[:, 0] << _RANK_BITS) + table[:, 1]

    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(*names)
    buckets = max(1, -(-int(counts.sum()) // BUCKET_ROWS))
    same = [c for c in pieces.columns if pieces.schema[c].dataType.typeName() not in ("map", "variant")]
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*same), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(F.col(length_col).alias("__length"), F.col("__bucket").alias("__of")).count()
    before = Window.partitionBy("__length").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__length", "__of", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(length_col, "__bucket").orderBy(*same)
    ranked = (
        dealt.withColumn("__rank", F.row_number().over(within))
        .join(bases, (F.col(length_col) == F.col("__length")) & (F.col("__bucket") == F.col("__of")))
        .withColumn("__rank", F.col("__rank") - 1 + F.col("__base"))
        .select(*names, "__rank")
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(length_col).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << _RANK_BITS) + rank, side="right") - 1
            sequence = table[at, 3] + rank - table[at, 1]
            columns = [batch.column(c) for c in names]
            yield pa.record_batch(
                [*columns, pa.array(sequence), pa.array(table[at, 4])], [*names, "sequence_id", "offset"]
            )

    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return map_arrow(ranked, assign, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Tokenize documents and pack their pieces into few sequences of at most `capacity` tokens.

    A null or empty text is `end_id` alone, a longer document than `capacity` is cut; nothing else is.
    Null ids, repeated rows and ties are packed like any other row, an empty table gives no rows, other
    columns are not read. Returns `id_col`, piece, start, length, ids_crc32, sequence_id, offset and ids.
    """
    pieces = token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids)
    return pack(stored(pieces, "pieces"), capacity)


def op9_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer, with_ids=False)
