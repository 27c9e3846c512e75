"""Removal of repeated line chunks.

Every line has a hash; a rolling hash over the hashes of the last `WINDOW` lines ends a chunk wherever
it is divisible by `DIVISOR`. So boundaries depend on nearby lines only, and an inserted or dropped
line moves no boundary further on. A chunk of two lines or more whose bytes occur at an earlier place
of the corpus (by document id, then place) is removed; single lines and blank chunks always stay.

Chunk hashes find the candidates; the texts of candidates are then grouped by their bytes. Documents
travel twice, once to read out candidate texts and once to be rewritten; counts are partial sums, so
a passage that a third of all documents share costs a row per task.

Chunks miss passages whose surroundings put no boundary around two of their lines. `dedup_passages`
finds the chunks that are repeated, and then extends these matches line by line: every window of two
lines that is not inside a chunk found is a candidate too, so where a passage lies makes no difference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from servicelens.llm.common import map_arrow, read, row_key, sliced, stored, texts_of

WINDOW = 2
DIVISOR = 2
LEAST_LINES = 2
#: A line of more words than this is a passage by itself.
LONG_LINE = 50
BASE = 1_000_003
MODULUS = (1 << 31) - 1


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.md5(line.encode(), usedforsecurity=False).digest()[:4], "big")


def chunk_ends(lines: list[str], window: int = WINDOW, divisor: int = DIVISOR) -> list[int]:
    """Where chunks end (exclusive line numbers); the last line always ends one."""
    hashes = [line_hash(line) for line in lines]
    leaving = pow(BASE, window, MODULUS)
    ends, rolling = [], 0
    for i, value in enumerate(hashes):
        gone = hashes[i - window] if i >= window else 0
        rolling = (rolling * BASE + value - gone * leaving) % MODULUS
        if rolling % divisor == 0:
            ends.append(i + 1)
    if not ends or ends[-1] != len(lines):
        ends.append(len(lines))
    return ends


def _chunks(docs: DataFrame) -> DataFrame:
    """(key, id, chunk, start, size, lines, hash) of the chunks that may be removed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows, numbers, starts, sizes, counts, hashes = [], [], [], [], [], []
            for row, text in enumerate(texts_of(batch, "text")):
                lines = text.split("\n")
                if len(lines) < LEAST_LINES:
                    continue
                first = start = 0
                for number, end in enumerate(chunk_ends(lines)):
                    chunk = "\n".join(lines[first:end])
                    if end - first >= LEAST_LINES and not chunk.isspace() and chunk:
                        rows.append(row)
                        numbers.append(number)
                        starts.append(start)
                        sizes.append(len(chunk))
                        counts.append(end - first)
                        hashes.append(xxhash.xxh64_intdigest(chunk.encode()) - (1 << 63))
                    first, start = end, start + len(chunk) + 1
            taken = pa.array(rows, pa.int32())
            numbers_ = [pa.array(x, pa.int32()) for x in (numbers, starts, sizes, counts)]
            yield pa.record_batch(
                [batch.column("key").take(taken), batch.column("id").take(taken), *numbers_, pa.array(hashes, pa.int64())],
                ["key", "id", "chunk", "start", "size", "lines", "hash"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return map_arrow(docs, cut, f"key binary, id {kind}, chunk int, start int, size int, lines int, hash long")


def _without(text: Column, ranges: Column) -> Column:
    """The lines of a text outside sorted character ranges (start, size) of whole lines."""

    def segment(i: Column) -> Column:
        before, now = F.get(ranges, i - 1), F.get(ranges, i)
        begin = F.coalesce(before["start"] + before["size"] + 1, F.lit(0))
        end = F.coalesce(now["start"] - 1, F.length(text))
        return F.when(end >= begin, F.substring(text, begin + 1, end - begin))

    pieces = F.transform(F.sequence(F.lit(0), F.size(ranges)), segment)
    return F.array_join(pieces, "\n")


def _places(chunks: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rows of `chunks` whose bytes have an earlier place, and (key, chunk) of the first places of repeated bytes.

    `texts` gives (key, id, chunk, hash, bytes) of those rows of `chunks` that it is called with. The bytes of rows that
    are `known` have a later place that is not among the rows.
    """
    place = F.struct(F.col("id").isNull().alias("null"), F.col("id"), F.col("key"), F.col("chunk"))
    known = "known" in chunks.columns
    again = F.bool_or("known") if known else F.lit(False)
    twice = chunks.groupBy("hash").agg(F.min(place).alias("a"), F.max(place).alias("b"), again.alias("again"))
    # kept as a table, so that the join below can split the rows of a hash that very many chunks share
    twice = stored(twice.where((F.col("a") != F.col("b")) | F.col("again")).select("hash"), "repeated-hashes")
    looked_up = texts(chunks.join(twice, "hash"))
    same = looked_up.groupBy("hash", "bytes").agg(F.min(place).alias("first")).select("hash", "first")
    same = stored(same, "same-bytes")
    # a hash with one text stands for it; the texts of any other hash are looked at themselves
    by_hash = same.groupBy("hash").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    by_hash = stored(by_hash, "first-places")
    single = by_hash.where(F.col("n") == 1)
    spare = chunks.join(single, "hash").where(place != F.col("first")).drop("id", "hash", "n", "first")
    held = single.select("first.key", "first.chunk")
    clashing = by_hash.where(F.col("n") > 1).select("hash")
    if not clashing.isEmpty():
        looked = looked_up.join(clashing, "hash")
        if known:
            looked = looked.join(chunks.select("key", "chunk", "known"), ["key", "chunk"])
        firsts = looked.groupBy("hash", "bytes").agg(
            F.min(place).alias("first"), F.max(place).alias("last"), again.alias("again")
        )
        later = looked.join(firsts, ["hash", "bytes"]).where(place != F.col("first")).select("key", "chunk")
        spare = spare.unionByName(later.distinct().join(chunks.drop("id", "hash"), ["key", "chunk"]))
        more = firsts.where((F.col("first") != F.col("last")) | F.col("again"))
        held = held.unionByName(more.select("first.key", "first.chunk"))
    return spare, held


def _repeated_chunks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What `_places` says of the chunks of (key, id, text)."""

    def texts(repeated: DataFrame) -> DataFrame:
        span = F.struct("chunk", "start", "size", "hash")
        wanted = repeated.groupBy("key").agg(F.collect_set(span).alias("spans"))
        return (
            docs.join(wanted, "key")
            .select("key", "id", "text", F.explode("spans").alias("s"))
            .select("key", "id", "s.chunk", "s.hash", F.expr("substring(text, s.start + 1, s.size)").alias("bytes"))
        )

    return _places(stored(_chunks(docs), "line-chunks"), texts)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with repeated line chunks removed, and removed_chunks and removed_lines (int).

    The first place of a chunk, by id (nulls last) and then place, keeps it. A document of which every
    chunk is repeated ends as an empty text; a null text stays null, an empty one empty. Rows equal in
    id and text are one place and get one result each. An empty table gives an empty result. Other
    columns pass through; columns named removed_chunks or removed_lines are replaced.
    """
    own = [c for c in docs.columns if c not in ("removed_chunks", "removed_lines")]
    docs = docs.select(*own, row_key(id_col, text_col).alias("__key"))
    narrow = docs.select(
        F.col("__key").alias("key"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    )
    spare, _ = _repeated_chunks(narrow)
    removed = spare.groupBy(F.col("key").alias("__of")).agg(
        F.sort_array(F.collect_set(F.struct("start", "size", "lines"))).alias("__ranges")
    )
    marked = docs.join(removed, F.col("__key") == F.col("__of"), "left")
    ranges = F.col("__ranges")
    text = F.when(ranges.isNull(), F.col(text_col)).otherwise(_without(F.col(text_col), ranges))
    lines = F.aggregate(ranges, F.lit(0), lambda total, r: total + r["lines"])
    return marked.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in own],
        F.coalesce(F.size(ranges), F.lit(0)).alias("removed_chunks"),
        F.coalesce(lines, F.lit(0)).alias("removed_lines"),
    )


def _windows(docs: DataFrame) -> DataFrame:
    """(key, id, chunk, hash, within) of every two lines in a row that are not blank, and of every long line.

    Number 2i stands for the lines i and i + 1, number 2i + 1 for line i alone. `within` is the number of the chunk
    of `_chunks` that holds these lines, null if a boundary parts them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in sliced(batches, "text"):
            rows, numbers, hashes, within = [], [], [], []
            for row, text in enumerate(texts_of(batch, "text")):
                lines = text.split("\n")
                if len(lines) > 1 or len(text) > 2 * LONG_LINE:
                    sizes = np.diff([0, *chunk_ends(lines)])
                    of = np.repeat(np.arange(len(sizes)), sizes).tolist()
                blank = [not line or line.isspace() for line in lines]
                found = [2 * i for i in range(len(lines) - 1) if not (blank[i] and blank[i + 1])]
                # so many words take two characters each
                found += [2 * i + 1 for i, x in enumerate(lines) if len(x) > 2 * LONG_LINE and len(x.split()) > LONG_LINE]
                rows += [row] * len(found)
                numbers += found
                hashes += [digest(_window(lines, n).encode()) - (1 << 63) for n in found]
                within += [of[n // 2] if n % 2 or of[n // 2] == of[n // 2 + 1] else None for n in found]
            taken = pa.array(rows, pa.int32())
            columns = [batch.column("key").take(taken), batch.column("id").take(taken)]
            columns += [pa.array(numbers, pa.int32()), pa.array(hashes, pa.int64()), pa.array(within, pa.int32())]
            yield pa.record_batch(columns, ["key", "id", "chunk", "hash", "within"])

    kind = docs.schema["id"].dataType.simpleString()
    return map_arrow(docs, cut, f"key binary, id {kind}, chunk int, hash long, within int")


def _window(lines: list[str], number: int) -> str:
    at, alone = divmod(number, 2)
    return lines[at] if alone else f"{lines[at]}\n{lines[at + 1]}"


def _window_texts(docs: DataFrame) -> DataFrame:
    """(key, id, chunk, hash, bytes) of the windows in `spans`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            spans = batch.column("spans")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
            numbers, hashes = spans.flatten().flatten()
            lines = [text.split("\n") for text in texts_of(batch, "text")]
            texts = [_window(lines[r], n) for r, n in zip(rows.tolist(), numbers.to_pylist(), strict=True)]
            taken = pa.array(rows)
            columns = [batch.column("key").take(taken), batch.column("id").take(taken), numbers, hashes]
            yield pa.record_batch([*columns, pa.array(texts, pa.string())], ["key", "id", "chunk", "hash", "bytes"])

    kind = docs.schema["id"].dataType.simpleString()
    return map_arrow(docs, cut, f"key binary, id {kind}, chunk int, hash long, bytes string")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without lines of repeated passages, and removed_lines (int).

    A passage is two lines in a row that are not both blank, or one line of more than `LONG_LINE` words;
    longer ones are made of these. Its first place, by id (nulls last) and then line, keeps it whole, also
    where it overlaps a passage that is repeated itself. All lines of other places go, so of a copy of a
    text of two lines or more nothing but blank lines is left. Other cases as in `dedup_lines`.

    Chunks are matched first, by hash and bytes. What lies in a later place of a chunk is repeated as it is; only
    the windows of the rest are looked up, those of first places among them.
    """
    own = [c for c in docs.columns if c != "removed_lines"]
    docs = docs.select(*own, row_key(id_col, text_col).alias("__key"))
    narrow = docs.select(
        F.col("__key").alias("key"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    )

    def texts(repeated: DataFrame) -> DataFrame:
        wanted = repeated.groupBy("key").agg(F.collect_set(F.struct("chunk", "hash")).alias("spans"))
        return _window_texts(narrow.join(wanted, "key"))

    windows = stored(_windows(narrow), "line-windows")
    later, first = (stored(f.select("key", F.col("chunk").alias("within")), "chunk-places") for f in _repeated_chunks(narrow))
    # equal rows share a key, so the places of a chunk may be listed more than once
    inside = windows.join(later, ["key", "within"], "left_semi")
    rest = windows.join(later, ["key", "within"], "left_anti")
    met = first.distinct().select("key", "within", F.lit(True).alias("known"))
    rest = rest.join(met, ["key", "within"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    spare, held = _places(stored(rest, "windows-left"), texts)
    spare = spare.select("key", "chunk").unionByName(inside.select("key", "chunk"))
    both = spare.select("key", F.col("chunk").alias("spare"), F.lit(None).cast("int").alias("held")).unionByName(
        held.select("key", F.lit(None).cast("int").alias("spare"), F.col("chunk").alias("held"))
    )
    marks = both.groupBy(F.col("key").alias("__of")).agg(
        F.collect_set("spare").alias("__spare"), F.collect_set("held").alias("__held")
    )
    marked = docs.join(marks.where(F.size("__spare") > 0), F.col("__key") == F.col("__of"), "left")
    marked = marked.withColumn(text_col, F.col(text_col).cast("string"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            texts, removed = batch.column(text_col).to_pylist(), [0] * batch.num_rows
            numbers = zip(batch.column("__spare").to_pylist(), batch.column("__held").to_pylist(), strict=True)
            for row, (gone, kept) in enumerate(numbers):
                if gone:
                    lines = texts[row].split("\n")
                    stays = set(range(len(lines))) - _lines_of(gone) | _lines_of(kept)
                    texts[row] = "\n".join(line for i, line in enumerate(lines) if i in stays)
                    removed[row] = len(lines) - len(stays)
            held = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in own]
            yield pa.record_batch([*held, pa.array(removed, pa.int32())], [*own, "removed_lines"])

    marked = marked.select(*own, "__spare", "__held")
    return map_arrow(marked, rewrite, marked.select(*own, F.lit(0).alias("removed_lines")).schema)


def _lines_of(numbers: list[int]) -> set[int]:
    return {n // 2 for n in numbers} | {n // 2 + 1 for n in numbers if n % 2 == 0}


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "removed_chunks", "removed_lines")


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), hashed AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM lines
), ended AS (
  SELECT *, (lag(h, 1, 0) OVER d * 1000003 + h) % 2147483647 % 2 = 0 AS ends
  FROM hashed WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER
    (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk
  FROM ended
), chunks AS (
  SELECT doc_id, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS bytes
  FROM numbered GROUP BY doc_id, chunk
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY doc_id, chunk) AS nth
  FROM chunks WHERE n >= 2 AND trim(regexp_replace(bytes, '\\s', '', 'g')) <> ''
), spare AS (SELECT doc_id, chunk, n FROM placed WHERE nth > 1),
counts AS (SELECT doc_id, count(*) AS c, sum(n) AS n FROM spare GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(bytes, chr(10) ORDER BY chunk) AS text
  FROM chunks ANTI JOIN spare USING (doc_id, chunk) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
  CAST(coalesce(c.c, 0) AS INTEGER) AS removed_chunks, CAST(coalesce(c.n, 0) AS INTEGER) AS removed_lines
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN counts c USING (doc_id)
"""
