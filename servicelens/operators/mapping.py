"""From export columns to canonical fields: propose, validate and apply a mapping; typed rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, trim_all

REQUIRED = ("id", "department", "status")

# Header patterns per field, matched without regard to case.
PATTERNS = (
    ("id", "^(request_?id|id)$"),
    ("department", "^(department|drejtoria)$"),
    ("status", "^(status|statusi)$"),
)


def propose_mapping(
    headers: DataFrame, patterns: Sequence[tuple[str, str]] = PATTERNS
) -> DataFrame:
    """(file, field, column_index): the first header that fits each field, or -1.

    `headers(file, position, header)`. The few patterns are constants, so this is one aggregation
    per file and no join.
    """
    firsts = [
        F.coalesce(
            F.min(F.when(F.col("header").rlike(f"(?i){pattern}"), F.col("position"))), F.lit(-1)
        ).alias(field)
        for field, pattern in patterns
    ]
    fields = [field for field, _ in patterns]
    return headers.groupBy("file").agg(*firsts).unpivot(["file"], fields, "field", "column_index")


def validate_mapping(
    mapping: DataFrame, headers: DataFrame, required: Sequence[str] = REQUIRED
) -> DataFrame:
    """(file, valid): every required field mapped, inside the file's columns, no column twice."""
    widths = headers.groupBy("file").agg(F.count("*").alias("n_columns"))
    is_required = F.col("field").isin(*required)
    index = F.when(is_required, F.col("column_index"))
    summary = mapping.groupBy("file").agg(
        F.min(index).alias("lowest"),
        F.max(index).alias("highest"),
        F.count_if(is_required).alias("given"),
        F.count_distinct(index).alias("different"),
    )
    valid = (
        (F.col("lowest") >= 0)
        & (F.col("highest") < F.col("n_columns"))
        & (F.col("given") == len(required))
        & (F.col("different") == len(required))
    )
    return summary.join(widths, "file", "left").select(
        "file", F.coalesce(valid, F.lit(False)).alias("valid")
    )


def apply_mapping(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Project named columns to canonical names: `{field: source column}`."""
    return df.select(*[F.col(source).alias(field) for field, source in mapping.items()])


def apply_file_mapping(rows: DataFrame, mapping: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The rows with a column per field in place of `cells`, by each file's own mapping.

    Files without a mapping drop out; pass only valid ones. The mapping is one row per file in the
    join, and an unmapped field is NULL.
    """
    positions = mapping.groupBy("file").agg(
        *[F.max(F.when(F.col("field") == f, F.col("column_index"))).alias(f"_{f}") for f in fields]
    )

    def cell(field: str) -> Column:
        at = F.col(f"_{field}").cast("int")
        return F.when(at >= 0, F.get("cells", at)).alias(field)

    kept = [c for c in rows.columns if c != "cells"]
    return rows.join(positions, "file").select(*kept, *[cell(f) for f in fields])


def _typed(name: str, kind: str) -> Column:
    return F.nullif(trim_all(F.col(name)), F.lit("")).try_cast(kind)


def coerce(df: DataFrame, types: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Typed rows, and (column, errors): how many given values did not fit their type.

    A value that does not fit is NULL in the typed rows. Counting is one pass over all columns.
    """
    typed = typed_rows(df, types)
    failed = [
        F.count_if(
            F.nullif(trim_all(F.col(name)), F.lit("")).isNotNull() & _typed(name, kind).isNull()
        ).alias(name)
        for name, kind in types.items()
    ]
    errors = df.agg(*failed).unpivot([], list(types), "column", "errors")
    return typed, errors


def with_faults(df: DataFrame, types: Mapping[str, str], required: Sequence[str] = ()) -> DataFrame:
    """The rows with their `faults`, (field, problem): `type` for a given value that does not fit, `missing` for a
    required one that is not there.

    Texts are trimmed in one step, judged in the next and listed in a third: as one expression this is more code than
    the JVM compiles.
    """
    names = list(dict.fromkeys([*types, *required]))

    def problem(name: str) -> Column:
        text = F.col(f"_text_{name}")
        found = F.when(text.isNull(), F.lit("missing" if name in required else None).cast("string"))
        return found.when(text.try_cast(types[name]).isNull(), "type") if name in types else found

    trimmed = df.withColumns({f"_text_{n}": F.nullif(trim_all(F.col(n).cast("string")), F.lit("")) for n in names})
    judged = trimmed.withColumns({f"_problem_{n}": problem(n) for n in names})
    none = F.array().cast("array<struct<field:string,problem:string>>")
    every = [
        F.when(F.col(f"_problem_{n}").isNotNull(), F.struct(F.lit(n).alias("field"), F.col(f"_problem_{n}").alias("problem")))
        for n in names
    ]
    sound = F.coalesce(*[F.col(f"_problem_{n}") for n in names], F.lit(None)).isNull()
    faults = F.when(sound, none).otherwise(F.array_compact(F.array(*every)))
    return judged.withColumn("faults", faults).drop(*[f"_{step}_{n}" for step in ("text", "problem") for n in names])


def checked_rows(
    df: DataFrame, types: Mapping[str, str], required: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Typed rows without a fault, and the given rows of the others with `faults`.

    Together the two tables hold every row once.
    """
    marked = with_faults(df, types, required)
    sound = F.size("faults") == 0
    return typed_rows(marked.where(sound).drop("faults"), types), marked.where(~sound)


def typed_rows(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """The rows with typed columns; a value that does not fit is NULL."""
    return df.withColumns({name: _typed(name, kind) for name, kind in types.items()})


def fault_counts(rejected: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    """(by, field, problem, rows) of rows with `faults`, such as those that `checked_rows` put aside."""
    keys = [col(c) for c in by]
    # the outer form keeps Spark from adding a filter on the size of the list
    listed = rejected.select(*keys, F.inline_outer("faults")).where(F.col("problem").isNotNull())
    return listed.groupBy(
        *[c for c in rejected.select(*keys).columns], "field", "problem"
    ).agg(F.count("*").alias("rows"))


def require_fields(df: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Complete rows, incomplete rows with `missing`, and (field, missing) counts."""
    missing = F.array_compact(F.array(*[F.when(col(f).isNull(), F.lit(f)) for f in fields]))
    complete = F.lit(True)
    for f in fields:
        complete = complete & col(f).isNotNull()
    counts = df.agg(*[F.count_if(col(f).isNull()).alias(f) for f in fields]).unpivot(
        [], list(fields), "field", "missing"
    )
    return df.where(complete), df.where(~complete).withColumn("missing", missing), counts


def decode_mapping(sources: DataFrame, column: str = "mapping_json") -> DataFrame:
    """`mapping_json` as a map from field to source column; NULL where it is not valid JSON."""
    return sources.withColumn("mapping", F.from_json(column, "map<string,string>"))


def mapping_json(mapping: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, mapping_json): field to header of each file, unmapped fields left out, for a table of sources."""
    named = mapping.join(
        headers.select("file", F.col("position").alias("column_index"), "header"), ["file", "column_index"]
    )
    pairs = F.sort_array(F.collect_list(F.struct("field", "header")))
    return named.groupBy("file").agg(F.to_json(F.map_from_entries(pairs)).alias("mapping_json"))


def saved_mapping(sources: DataFrame, headers: DataFrame, proposed: DataFrame) -> DataFrame:
    """(file, field, column_index, origin): the saved mapping of a source for its next upload.

    `sources(source, mapping_json)` holds one mapping per source, `headers(file, source, position,
    header)` are those of new files. A file that lacks a saved header gets its proposed mapping.
    """
    wanted = decode_mapping(sources).select("source", F.explode("mapping").alias("field", "header"))
    files = headers.select("file", "source").distinct()
    found = (
        files.join(wanted, "source")
        .join(headers.select("file", "header", "position"), ["file", "header"], "left")
        .select("file", "field", F.col("position").alias("column_index"))
    )
    whole = found.groupBy("file").agg(F.bool_and(F.col("column_index").isNotNull()).alias("whole")).where("whole")
    kept = found.join(whole.select("file"), "file", "left_semi").withColumn("origin", F.lit("saved"))
    rest = proposed.join(files.select("file"), "file", "left_semi").join(whole.select("file"), "file", "left_anti")
    return kept.unionByName(rest.select("file", "field", "column_index").withColumn("origin", F.lit("proposed")))
