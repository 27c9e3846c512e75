"""One way from export files to requests: every delivered row is kept, as a request or in quarantine.

A source's delivery is one table partition: its sound rows, typed; its faulty rows as they were given, with their
faults; and a row for every file that was refused. Each row carries the source, the file and the place in it.
A source that is delivered again replaces its partition, so nothing counts twice and nothing stays behind.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mapping as mp
from ..session import staging_path
from . import exports, store

CANONICAL, FAULTY, REFUSED = "canonical", "faulty", "refused"

_FAULTS = "array<struct<field:string,problem:string>>"


def file_mapping(verdicts: DataFrame, patterns: Sequence[tuple[str, str]], required: Sequence[str]) -> DataFrame:
    """(file, field, column_index, valid) of accepted files, proposed from their headers."""
    headers = exports.header_cells(verdicts)
    proposed = mp.propose_mapping(headers, patterns)
    return proposed.join(mp.validate_mapping(proposed, headers, required), "file")


def deal_rows(
    records: DataFrame,
    verdicts: DataFrame,
    mapping: DataFrame,
    source: Column,
    types: Mapping[str, str],
    fields: Sequence[str],
    required: Sequence[str],
) -> DataFrame:
    """Every data row of the accepted files, and a row for each refused one.

    Columns: source_id, file, pos, outcome, the fields (typed; NULL where a value does not fit), given (the
    texts of a faulty row by field), faults (field, problem). Problems are `type` and `missing`, for a field
    without a column `unmapped`, and for a refused file the verdict, with no field. `source` says from a file's
    name which source it belongs to; `records` is the landed table.
    """
    lost = F.array_compact(F.collect_list(F.when(F.col("column_index") < 0, F.col("field"))))
    by_file = mapping.where(F.col("field").isin(*required)).groupBy("file").agg(lost.alias("_unmapped"))
    # what is the same for all rows of a file is made once a file
    judged = verdicts.withColumn("source_id", source).join(by_file, "file")
    rows = exports.data_records(records, judged, ["source_id", "_unmapped"])
    marked = mp.with_faults(mp.apply_file_mapping(rows, mapping, fields), types, required)
    faulty = F.size("faults") > 0
    named = F.transform(
        "faults",
        lambda f: F.struct(
            f["field"].alias("field"),
            F.when(F.array_contains("_unmapped", f["field"]), "unmapped").otherwise(f["problem"]).alias("problem"),
        ),
    )
    marked = marked.withColumn("faults", F.when(faulty & (F.size("_unmapped") > 0), named).otherwise(F.col("faults")))
    texts = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f) for f in fields]))
    marked = marked.withColumn("given", F.when(faulty, F.map_filter(texts, lambda _, v: v.isNotNull())))
    kept = mp.typed_rows(marked, types).select(
        "source_id",
        "file",
        "pos",
        F.when(faulty, FAULTY).otherwise(CANONICAL).alias("outcome"),
        *fields,
        "given",
        F.col("faults").cast(_FAULTS).alias("faults"),
    )
    verdict = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.col("verdict").alias("problem")))
    values = {"outcome": F.lit(REFUSED), "faults": verdict.cast(_FAULTS), "source_id": source, "file": F.col("file")}
    refused = verdicts.where(F.col("verdict") != "ok").select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kept.schema.fields]
    )
    return kept.unionByName(refused)


def ingest(
    spark: SparkSession,
    records: DataFrame,
    verdicts: DataFrame,
    source: Column,
    path: str,
    delivery: int,
    types: Mapping[str, str],
    patterns: Sequence[tuple[str, str]],
    required: Sequence[str] = mp.REQUIRED,
    sources: Sequence[str] | None = None,
) -> None:
    """Write a delivery: every source in it, or the `sources` named, replaces what is kept of it.

    The rows and the log of deliveries are below `path`. One write, one shuffle that spreads a large source over
    tasks and files; a delivery that breaks off can be given again.
    """
    if sources is not None:  # rows follow their files
        verdicts = verdicts.where(source.isin(*sources))
    # a row per field and file, whose size the planner then knows
    mapping = store.save_table(file_mapping(verdicts, patterns, required), staging_path(spark, "file-mapping"))
    dealt = deal_rows(records, verdicts, mapping, source, types, [f for f, _ in patterns], required)
    store.write_delivery(dealt, f"{path}/rows", f"{path}/log", delivery, sort_by="outcome")


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """All rows that are kept, with their outcome and the number of their delivery."""
    return store.read_by_source(spark, f"{path}/rows")


def canonical_rows(spark: SparkSession, path: str) -> DataFrame:
    return ingested(spark, path).where(F.col("outcome") == CANONICAL).drop("given", "faults", "outcome")


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, file, pos, outcome, given, faults, delivery) of faulty rows and refused files."""
    kept = ingested(spark, path).where(F.col("outcome") != CANONICAL)
    return kept.select("source_id", "file", "pos", "outcome", "given", "faults", "delivery")


def delivery_log(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, rows, delivery)"""
    return spark.read.parquet(f"{path}/log")


def release(
    spark: SparkSession,
    path: str,
    corrections: DataFrame,
    types: Mapping[str, str],
    fields: Sequence[str],
    required: Sequence[str],
    delivery: int,
) -> None:
    """Take corrected rows out of quarantine.

    corrections: source_id, file, pos and `given`, the corrected texts by field, those to change only. The sources
    they belong to are written again; corrected rows that still have a fault stay, with their new texts.
    """
    place = ["source_id", "file", "pos"]
    named = [r["source_id"] for r in corrections.select("source_id").distinct().collect()]
    kept = ingested(spark, path).where(F.col("source_id").isin(*named))
    mended = kept.join(corrections.select(*place, F.col("given").alias("_mended")), place, "left")
    again = F.col("_mended").isNotNull() & (F.col("outcome") == FAULTY)
    old = mended.where(~again).drop("_mended")
    texts = F.map_concat(F.map_filter("given", lambda k, _: ~F.array_contains(F.map_keys("_mended"), k)), "_mended")
    rows = mended.where(again).select(
        *place, texts.alias("given"), *[F.element_at(texts, F.lit(f)).alias(f) for f in fields], "delivery"
    )
    rows = mp.with_faults(rows, types, required)
    faulty = F.size("faults") > 0
    rows = mp.typed_rows(rows, types).withColumns(
        {"outcome": F.when(faulty, FAULTY).otherwise(CANONICAL), "given": F.when(faulty, F.col("given"))}
    )
    merged = old.unionByName(rows.select(*old.columns)).drop("delivery")
    # what is read is also overwritten, so it is put aside first
    aside = store.save_table(merged, staging_path(spark, "released"))
    store.write_delivery(aside, f"{path}/rows", f"{path}/log", delivery, sort_by="outcome")
