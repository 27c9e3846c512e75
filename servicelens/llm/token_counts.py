"""Token counts of whole texts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from servicelens.llm.byte_bpe import ByteVocabulary
from servicelens.llm.common import WordCache, map_arrow, read, sliced, texts_of

#: A document of more tokens is marked.
LIMIT = 1024

_loaded: dict[str, tuple[ByteVocabulary, WordCache]] = {}


def counter(path: str) -> tuple[ByteVocabulary, WordCache]:
    """The vocabulary and the counts of words seen so far, once for each Python worker."""
    if path not in _loaded:
        _loaded[path] = ByteVocabulary(path), WordCache()
    return _loaded[path]


def count_texts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text. A special string of the vocabulary inside a text is one token."""
    vocabulary, cache = counter(path)
    totals = [0] * len(texts)

    def add(held: list[tuple[int, list[str]]]) -> None:
        used = set().union(*[words for _, words in held])
        cache.shrink(used)
        if new := cache.missing(used):
            _, counts = vocabulary.merger.encode([w.encode() for w in new])
            cache.update(zip(new, counts.tolist(), strict=True))
        for i, words in held:
            totals[i] += sum(map(cache.__getitem__, words))

    held: list[tuple[int, list[str]]] = []
    chars = 0
    for i, text in enumerate(texts):
        for part, special in vocabulary.parts(text):
            held.append((i, vocabulary.words(part)))
            totals[i] += bool(special)
            chars += len(part)
            if chars >= 1 << 20:
                add(held)
                held, chars = [], 0
    add(held)
    return totals


def token_counts(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per document: `id_col`, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    `tokenizer` is the path of a byte-level `tokenizers` file, there on every executor. No begin, end
    or other special token is added; special strings inside a text count as the library counts them.
    Null and empty texts have 0 tokens, null ids stay, equal rows give equal rows, an empty table an
    empty result; other columns are neither read nor returned. No shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            tokens = count_texts(texts_of(batch, "text"), tokenizer)
            yield pa.record_batch(
                [batch.column("id"), sizes, pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    counted = map_arrow(narrow, count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
