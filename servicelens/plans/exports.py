"""CSV exports written from the order tables, good ones and broken ones, to feed the import."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staging_path
from ..sources.store import save_table
from . import canonical

# Orders per export file and source: files stay this small however many orders there are.
SHARD = 50_000

# Headers in Albanian for one source, in English for the others.
ALBANIAN_SOURCE = "ASIA"

# Files of the kind `wide` have one column more than this.
MOST_COLUMNS = 50


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """What is exported, joined once and kept for all files."""
    rows = canonical.requests(spark, path, located=True, closings=False).select(
        F.col("source_id").alias("source"),
        F.floor(F.col("id") / SHARD).alias("shard"),
        F.col("id"),
        F.col("department_id").alias("department"),
        "status",
        F.col("created_at").cast("date").alias("created_at"),
        F.format_string('Request "%d", %s\nsecond line', F.col("id"), F.col("category_id")).alias("note"),
    )
    return save_table(rows, staging_path(spark, "export-rows"))


#: Orders per task that writes exports, so that what a task sorts does not grow with the orders.
TASK_ROWS = 100_000


def write_exports(spark: SparkSession, path: str, kinds: Sequence[str] = ()) -> str:
    """Exports of the `kinds` named, or of all; returns their folder. A kind is the same whatever is written beside it."""
    out, rows = staging_path(spark, "exports"), _rows(spark, path)
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    rows = rows.repartition(tasks, "source", "shard")
    if not kinds or "good" in kinds:
        _write_good(rows, out)
    if not kinds or set(kinds) - {"good"}:
        _write_broken(rows, out, kinds)
    return out


# Lines go out as CSV files as they are: no quote character and nothing trimmed.
AS_THEY_ARE = {
    "header": False,
    "quote": "\u0000",
    "escape": "\u0000",
    "sep": "\u0001",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

#: Folders of exports by session, tables and what the tables' files were.
_kept: dict[tuple, str] = {}


def _stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Which files the order tables are made of, their sizes and times."""
    tables = [f"{path}/{t}.parquet" for t in ("orders", "customer", "nation", "region")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(tables)
    mark = F.xxhash64("path", "length", "modificationTime")
    return tuple(files.agg(F.count("*"), F.bit_xor(mark)).first())


def _still_there(spark: SparkSession, key: tuple) -> str | None:
    """The folder kept under a key, unless it was cleared away."""
    if key not in _kept:
        return None
    try:
        spark.read.option("recursiveFileLookup", True).text(_kept[key])  # looks for the folder only
    except AnalysisException:
        return None
    return _kept[key]


def kept_exports(spark: SparkSession, path: str, kinds: Sequence[str] = ()) -> str | list[str]:
    """The folder of exports of every kind, or the folders of the `kinds` named, written once per session for the
    tables as they are.
    """
    tables = (spark.sparkContext.applicationId, path, _stamp(spark, path))
    for key in dict.fromkeys([tables, (*tables, *kinds)]):
        out = _still_there(spark, key)
        if out:
            break
    else:
        out = _kept[key] = write_exports(spark, path, kinds)
    return [f"{out}/kind={kind}" for kind in kinds] if kinds else out


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, year, id, line): a plain line per order, and a header for each source and year."""
    rows = canonical.requests(spark, path, located=True, closings=False).select(
        F.col("source_id").alias("source"), F.year("created_at").alias("year"), "id", "department_id", "status"
    )
    lines = rows.select("source", "year", "id", F.concat_ws(",", "id", "department_id", "status").alias("value"))
    titles = rows.select("source", "year").distinct()
    return lines.unionByName(titles.select("*", F.lit(-1).alias("id"), F.lit("id,department,status").alias("value")))


def write_delivered(spark: SparkSession, path: str, out: str, years: tuple[int, int], separator: str = "\n") -> None:
    """One file per source and year from the first to before the second of `years`, added to a folder."""
    year = F.col("year")
    (
        _lines(spark, path)
        .where((year >= years[0]) & (year < years[1]))
        .repartition("source", "year")
        .sortWithinPartitions("source", "year", "id")
        .select("source", "year", "value")
        .write.mode("append")
        .partitionBy("source", "year")
        .options(**AS_THEY_ARE, lineSep=separator)
        .csv(out)
    )


#: Headers of exports that follow no pattern, and the fields in their columns; some columns are of no field.
ODD_HEADERS = {
    "AFRICA": (["Dept_Name", "Req No", "Statusi", "Opened on", "Comment"], ["department", "id", "status", "created_at", "note"]),
    "AMERICA": (
        ["Data e hapjes", "Gjendja", "Nr. i kërkesës", "Drejtoria", "Shënime"],
        ["created_at", "status", "id", "department", "note"],
    ),
    "ASIA": (["department_head", "id", "department", "created", "status"], ["head", "id", "department", "created_at", "status"]),
    "EUROPE": (["StatusCode", "RequestId", "DepartmentName", "CreatedAt", "amount"], ["status", "id", "department", "created_at", "amount"]),
    "MIDDLE EAST": (["a1", "b2", "c3", "d4", "e5"], ["x", "x", "x", "x", "x"]),
}


def write_odd(spark: SparkSession, path: str, out: str) -> None:
    """One folder of exports per source, each with headers of its own."""
    rows = save_table(
        canonical.requests(spark, path, located=True, closings=False), staging_path(spark, "odd-rows")
    )
    given = {
        "id": F.col("id"),
        "department": F.col("department_id"),
        "status": F.col("status"),
        "created_at": F.col("created_at").cast("date"),
        "note": F.concat(F.lit("request "), F.col("id"), F.lit(", "), F.col("category_id")),
        "head": F.concat(F.lit("head of "), F.col("department_id")),
        "amount": F.col("id") % 1000,
        "x": F.col("status"),
    }
    for source, (headers, fields) in ODD_HEADERS.items():
        chosen = rows.where(F.col("source_id") == source)
        named = [given[f].alias(h) for h, f in zip(headers, fields, strict=True)]
        chosen.select(*named).write.options(header=True, escape='"').csv(f"{out}/source={source}")


def write_empty(spark: SparkSession, out: str) -> None:
    """A file of zero bytes."""
    spark.range(0).select(F.lit("").alias("value")).coalesce(1).write.mode("append").csv(out)


def _write_good(rows: DataFrame, out: str) -> None:
    """One file per source and shard, which `rows` has in one partition: quoted cells with commas, quotes and line breaks."""
    albanian = F.col("source") == ALBANIAN_SOURCE
    named = (
        (rows.where(~albanian).withColumnRenamed("id", "request_id"), "en"),
        (
            rows.where(albanian).withColumnsRenamed({"department": "Drejtoria", "status": "Statusi"}),
            "sq",
        ),
    )
    for frame, locale in named:
        first = frame.columns[2]
        (
            frame.sortWithinPartitions("source", "shard", first)
            .write.partitionBy("source", "shard")
            .options(header=True, escape='"')
            .csv(f"{out}/kind=good/locale={locale}")
        )


def _write_broken(rows: DataFrame, out: str, kinds: Sequence[str] = ()) -> None:
    """One file per kind of fault, source and shard, written as bare lines.

    Lines are made after the orders of a source and shard were brought together, so none is shuffled. `blank` files
    are sound: blank lines between records count for nothing.
    """
    line = F.concat_ws(",", "id", "department", "status")
    faulty = F.col("status") == "in_progress"
    texts: dict[str, tuple[str, Column | None]] = {
        "headers": ("id,ID,status", line),
        "ragged": ("id,department,status", F.when(faulty, F.concat(line, F.lit(",extra"))).otherwise(line)),
        "unclosed": (
            "id,department,status",
            F.when(faulty, F.concat_ws(",", "id", "department", F.lit('"open'))).otherwise(line),
        ),
        "empty": ("id,department,status", None),
        "text": ("id,department,status", line),
        "blank": ("id,department,status", line),
        "unmapped": ("id,place,status", line),
        "faulty": (
            "request_id,department,status,created_at",
            F.concat_ws(
                ",",
                F.when(faulty, F.concat(F.lit("x"), F.col("id").cast("string"))).otherwise(F.col("id").cast("string")),
                F.when(F.col("id") % 10 == 1, " ").otherwise(F.col("department")),
                "status",
                F.when(F.col("id") % 15 == 2, "soon").otherwise(F.col("created_at").cast("string")),
            ),
        ),
        "wide": (
            ",".join(["id", *(f"c{i}" for i in range(MOST_COLUMNS))]),
            F.concat(F.col("id").cast("string"), F.lit("," * MOST_COLUMNS)),
        ),
    }

    texts = {kind: text for kind, text in texts.items() if not kinds or kind in kinds}
    plain = {kind: texts.pop(kind) for kind in ["text"] if kind in texts}
    parts = ["kind", "source", "shard"]
    if plain:
        _broken_lines(rows, plain, faulty).write.partitionBy(*parts).mode("append").text(out)
    if texts:
        lines = _broken_lines(rows, texts, faulty)
        lines.write.partitionBy(*parts).mode("append").options(**AS_THEY_ARE).csv(out)


def _broken_lines(rows: DataFrame, texts: dict[str, tuple[str, Column | None]], faulty: Column) -> DataFrame:
    """(kind, source, shard, line) by file: the title and a line per order of each kind."""

    def entry(kind: str, order: Column, text: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), order.cast("long").alias("line_no"), text.alias("line")
        )

    titles = F.array(*[entry(k, F.lit(-1), F.lit(title)) for k, (title, _) in texts.items()])
    bodies = [entry(k, F.col("id"), body) for k, (_, body) in texts.items() if body is not None]
    if "blank" in texts:
        bodies += [F.when(faulty, entry("blank", F.col("id"), F.lit(gap))) for gap in ("  ", "\t")]
    # the order of a file that comes first brings the title; ids of a shard may be any, so it is looked for
    first = Window.partitionBy("source", "shard").orderBy("id")
    given = F.array_compact(F.array(*bodies))
    return (
        rows.withColumn("_leads", F.row_number().over(first) == 1)
        .select("source", "shard", F.inline(F.when(F.col("_leads"), F.concat(titles, given)).otherwise(given)))
        .sortWithinPartitions("kind", "source", "shard", "line_no")
        .drop("line_no")
    )


def path_part(name: str) -> Column:
    """A `name=value` folder of the file's path."""
    return F.url_decode(F.regexp_extract("file", f"/{name}=([^/]+)/", 1))
