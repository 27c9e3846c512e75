"""Language identification of words, spans and whole texts.

Training counts hashed letter trigrams and scripts by language over all labelled documents; the model
is a table of `BUCKETS` scores per language. A word is a run of letters; the script of its first letter
narrows the languages it can be in, the sum of its trigrams' log probabilities scores them. Viterbi
decoding with a penalty for every switch labels the words of a text; equal labels in a row are a span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from servicelens.llm.common import map_arrow, read, slices, texts_of

BUCKETS = 1 << 14
#: A language is possible in a script that has at least this share of its letters.
SCRIPT_SHARE = 0.01
SWITCH_PENALTY = 12.0
#: The model goes to every task; more languages than fit in this many bytes are refused.
MODEL_BYTES = 64 << 20
UNKNOWN = "und"

#: Letters are scored in batches of this many characters; a longer text is cut between words for it.
PART_CHARS = 2 << 20

_SLICE = 2 << 20
_GAP = re.compile(r"[\W\d_]")

# First code points of script ranges, in order. Code points before and between named
# ranges belong to the script of the range they follow.
SCRIPTS = [
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0700, "syriac"),
    (0x0750, "arabic"),
    (0x0780, "other"),
    (0x0900, "devanagari"),
    (0x0980, "bengali"),
    (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"),
    (0x0B00, "oriya"),
    (0x0B80, "tamil"),
    (0x0C00, "telugu"),
    (0x0C80, "kannada"),
    (0x0D00, "malayalam"),
    (0x0D80, "sinhala"),
    (0x0E00, "thai"),
    (0x0E80, "lao"),
    (0x0F00, "tibetan"),
    (0x1000, "myanmar"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "ethiopic"),
    (0x13A0, "other"),
    (0x1780, "khmer"),
    (0x1800, "mongolian"),
    (0x18B0, "other"),
    (0x1C80, "cyrillic"),
    (0x1C90, "georgian"),
    (0x1CC0, "other"),
    (0x1D00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x2C60, "latin"),
    (0x2C80, "other"),
    (0x3040, "kana"),
    (0x3100, "han"),
    (0x3130, "hangul"),
    (0x3190, "han"),
    (0x31F0, "kana"),
    (0x3200, "han"),
    (0xA000, "other"),
    (0xA720, "latin"),
    (0xA800, "other"),
    (0xAC00, "hangul"),
    (0xD800, "other"),
    (0xF900, "han"),
    (0xFB00, "latin"),
    (0xFB1D, "hebrew"),
    (0xFB50, "arabic"),
    (0xFF00, "latin"),
    (0xFF66, "kana"),
    (0xFFA0, "hangul"),
    (0x10000, "other"),
    (0x20000, "han"),
    (0x30000, "han"),
    (0x40000, "other"),
]

_STARTS = np.array([start for start, _ in SCRIPTS])
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter, once for each Python worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


class Words(NamedTuple):
    """Words of a batch of texts, one after the other."""

    document: np.ndarray  # of each word
    start: np.ndarray  # code point in its document
    size: np.ndarray  # letters
    first: np.ndarray  # place of its first letter in `bucket`
    script: np.ndarray
    bucket: np.ndarray  # hashed trigram of each letter


def word_batches(texts: list[str]) -> Iterator[Words]:
    """The words of all texts in batches of about `PART_CHARS`; a longer text is cut between words."""
    parts: list[str] = []
    places: list[tuple[int, int]] = []  # text of each part and where it starts there
    chars = 0
    for i, text in enumerate(texts):
        start = 0
        while True:
            stop = len(text)
            if stop - start > PART_CHARS and (gap := _GAP.search(text, start + PART_CHARS)):
                stop = gap.start()
            parts.append(text[start:stop])
            places.append((i, start))
            chars += stop - start
            if chars >= PART_CHARS:
                yield _placed(words_of(parts), places)
                parts, places, chars = [], [], 0
            if stop == len(text):
                break
            start = stop
    yield _placed(words_of(parts), places)


def _placed(words: Words, places: list[tuple[int, int]]) -> Words:
    at = np.array(places, np.int64).reshape(-1, 2)
    return words._replace(document=at[words.document, 0], start=words.start + at[words.document, 1])


def words_of(texts: list[str]) -> Words:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.r_[0, np.cumsum(lengths + 1)]
    joined = "\0".join(texts) + "\0"
    lowered = joined.lower()
    if len(lowered) != len(joined):  # some letters become two in lower case
        lowered = "".join(low if len(low := c.lower()) == 1 else c for c in joined)
    # the mark after each text parts its words from the next one's; the last one also precedes the first
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = letters()[points]
    masked = np.where(is_letter, points, 0)
    at = np.flatnonzero(is_letter)
    mixed = masked[at - 1] * 0x9E3779B1 + masked[at] * 0x85EBCA77 + masked[at + 1] * 0xC2B2AE3D
    mixed ^= mixed >> 29
    bucket = ((mixed * 0x27D4EB2F) >> 15) & (BUCKETS - 1)
    first = np.flatnonzero(np.r_[True, np.diff(at) != 1]) if at.size else at
    place = at[first]
    document = np.searchsorted(starts, place, side="right") - 1
    size = np.diff(np.r_[first, at.size])
    script = _SCRIPT_OF[np.searchsorted(_STARTS, points[place], side="right") - 1]
    return Words(document, place - starts[document], size, first, script, bucket)


class Model(NamedTuple):
    languages: list[str]
    scores: np.ndarray  # buckets x languages
    allowed: np.ndarray  # scripts x languages


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count trigrams and scripts by language over every row with a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                texts, langs = texts_of(part, "text"), part.column("lang").to_pylist()
                for lang in set(langs):
                    seen = totals.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                    for words in word_batches([t for t, held in zip(texts, langs, strict=True) if held == lang]):
                        seen[:BUCKETS] += np.bincount(words.bucket, minlength=BUCKETS)
                        by_script = np.bincount(words.script, words.size, len(SCRIPT_NAMES))
                        seen[BUCKETS:] += by_script.astype(np.int64)
        for lang, seen in totals.items():
            held = np.flatnonzero(seen)
            columns = [pa.array([lang] * held.size, pa.string()), pa.array(held), pa.array(seen[held])]
            yield pa.record_batch(columns, ["lang", "bucket", "n"])

    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = map_arrow(labelled, count, "lang string, bucket long, n long")
    counted = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    most = MODEL_BYTES // (4 * BUCKETS)
    # a row per bucket and language: bounded by the size of the model, which is checked
    rows = counted.limit(most * (BUCKETS + len(SCRIPT_NAMES)) + 1).toPandas()
    languages = sorted(rows["lang"].unique())
    if len(languages) > most:
        raise ValueError(f"{len(languages)} languages or more make a model beyond {MODEL_BYTES} bytes")
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    counts[rows["bucket"], np.searchsorted(languages, rows["lang"])] = rows["n"]
    grams, scripts = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), allowed)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; `counts` words of each text follow each other in `scores`.

    All texts advance together, the longest first, so a step handles those that still have words.
    """
    total, labels = scores.shape
    order = np.argsort(-counts, kind="stable")
    counts = counts[order]
    starts = (np.r_[0, np.cumsum(counts[np.argsort(order)])[:-1]])[order]
    active = np.searchsorted(-counts, -np.arange(counts[0] if counts.size else 0), side="left")
    back = np.empty((total, labels), np.int16)
    stay = np.arange(labels, dtype=np.int16)
    value = np.zeros((counts.size, labels))
    for t, n in enumerate(active.tolist()):
        now = value[:n]
        top = now.argmax(axis=1)
        switched = now[np.arange(n), top] - penalty
        moves = switched[:, None] > now
        words = starts[:n] + t
        back[words] = np.where(moves, top[:, None], stay)
        value[:n] = np.where(moves, switched[:, None], now) + scores[words]
    label = value.argmax(axis=1)
    found = np.empty(total, np.int16)
    for t in range(active.size - 1, -1, -1):
        n = active[t]
        words = starts[:n] + t
        found[words] = label[:n]
        label[:n] = back[words, label[:n]]
    return found


def label_texts(texts: list[str], model: Model, penalty: float = SWITCH_PENALTY) -> tuple[list[str], np.ndarray, tuple]:
    """Language and score of each text, and spans as (text, language, start, end) arrays."""
    known = len(model.languages)
    found = []
    for words in word_batches(texts):
        if words.size.size and known:
            scores = np.add.reduceat(model.scores[words.bucket], words.first, axis=0)
            scores = np.where(model.allowed[words.script], scores, scores - np.float32(1e4))
            found.append((words.document, words.start, words.size, scores))
    if not found:
        empty = np.zeros(0, np.int64)
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), (empty, empty, empty, empty)
    document, start, size, scores = (np.concatenate(x) for x in zip(*found, strict=True))
    counts = np.bincount(document, minlength=len(texts))
    label = viterbi(scores, counts, penalty).astype(np.int64)
    shares = np.bincount(document * known + label, size, len(texts) * known).reshape(-1, known)
    total, best = shares.sum(axis=1), shares.argmax(axis=1)
    score = shares[np.arange(len(texts)), best] / np.maximum(total, 1)
    language = [model.languages[i] if n else UNKNOWN for i, n in zip(best.tolist(), total.tolist(), strict=True)]
    fresh = np.r_[True, (np.diff(label) != 0) | (np.diff(document) != 0)]
    begin = np.flatnonzero(fresh)
    end = np.r_[begin[1:], label.size] - 1
    spans = document[begin], label[begin], start[begin], start[end] + size[end]
    return language, score, spans


def held_out(id_col: str) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 by 3. No id: neither."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True
) -> DataFrame:
    """One row per document: `id_col`, lang_pred, score (share of letters in that language), spans.

    Spans are (lang, start, end) in code points, end exclusive, from the first to the last word of a
    stretch. A null text, one without a letter, or any text under a model of no language is `und` with
    score 0 and no spans. Ties go to the language first in the alphabet. Null ids stay, repeated rows
    come back as often as they are there, an empty table gives an empty result, other columns are not
    read. The model is bounded by `MODEL_BYTES`.
    """

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = _labelled(narrow, model, with_spans)
    return found.select(F.col("id").alias(id_col), "lang_pred", "score", *["spans"] * with_spans)


def label_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with __lang and __score beside all its columns; cases as in `identify`."""
    found = _labelled(docs.withColumn("__text", F.col(text_col).cast("string")), model, False, "__text", "__")
    return found.withColumnsRenamed({"__lang_pred": "__lang"}).drop("__text")


def _labelled(
    rows: DataFrame, model: Model, with_spans: bool, text: str = "text", prefix: str = ""
) -> DataFrame:
    names = pa.array(model.languages, pa.string())
    own = rows.columns
    added = [prefix + c for c in ("lang_pred", "score", "spans")]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, _SLICE):
                language, score, (document, lang, start, end) = label_texts(texts_of(part, text), model)
                columns = [*part.columns, pa.array(language, pa.string()), pa.array(score)]
                if with_spans:
                    offsets = np.r_[0, np.cumsum(np.bincount(document, minlength=part.num_rows))]
                    held = [names.take(pa.array(lang)), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
                    span = pa.StructArray.from_arrays(held, ["lang", "start", "end"])
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), span))
                yield pa.record_batch(columns, [*own, *added][: len(columns)])

    kinds = ["string", "double", "array<struct<lang:string,start:int,end:int>>"][: 2 + with_spans]
    blank = [F.lit(None).cast(k).alias(c) for k, c in zip(kinds, added, strict=False)]
    return map_arrow(rows, label, rows.select("*", *blank).schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")))
    found = identify(docs, model, with_spans=False)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
