"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, secret scan, best-fit packing.

Every stage takes the documents its predecessor kept and returns documents of the same columns; the last
one returns packed pieces. Stages read doc_id, text and, to learn from, lang; other columns pass through.
Null ids, null and empty texts, repeated rows and empty tables are no errors in any stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from servicelens.llm.common import read, stored
from servicelens.llm.language_id import UNKNOWN, held_out, label_documents, train
from servicelens.llm.line_dedup import dedup_passages
from servicelens.llm.near_copies import near_copies
from servicelens.llm.packing import pack_documents
from servicelens.llm.secret_scan import mask_secrets

#: A text is kept if at least this share of its letters is in the language found: texts in two or three
#: languages stay.
LEAST_SHARE = 0.3


def _with_text(docs: DataFrame, text: DataFrame) -> DataFrame:
    """`text` with the columns of `docs`, n_chars made right."""
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    kinds = dict(docs.dtypes)
    return text.select(
        *[length.cast(kinds[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    )


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop null texts, texts without a letter and texts split over so many languages that none has a share.

    A text in a language or script that was never learned gets the label of the learned language that is
    likest to it; it is not told from a text in that language and stays. The model learns from the labelled documents of the input, the held-out third aside.
    """
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")))
    labelled = label_documents(docs, model)
    kept = labelled.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= LEAST_SHARE))
    return kept.select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated passages of lines, and documents of which nothing but white space is left by that."""
    found = dedup_passages(docs)
    emptied = (F.col("removed_lines") > 0) & ~F.col("text").rlike(r"\S")
    return _with_text(docs, found.where(~emptied))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near copies: the one with the smallest id, of several rows with
    that id the one whose text comes first.

    Copies are texts of which 0.8 or more of the five-word shingles are the same. Rows without an id have no place
    in this order; they stay if no row of their component has an id.
    """
    of = near_copies(docs).select("doc_id", "component_id").distinct()
    kept = of.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"))
    first = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    named, nameless = first.where(F.col("doc_id").isNotNull()), first.where(F.col("doc_id").isNull())
    ordered = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind]
    least = named.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", *ordered)).alias("__row"))
    one = least.select("__row.*")
    return one.unionByName(nameless)


def mask_found_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mask in the place of every secret."""
    return _with_text(docs, mask_secrets(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1,024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scan", mask_found_secrets),
    ("best-fit packing", pack_sequences),
]

# Language models and vocabularies have no form in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again for the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
