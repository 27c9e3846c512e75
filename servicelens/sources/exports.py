"""Department CSV exports: raw records, strict file checks, verdicts and previews.

Spark's CSV reader forgives what a careful import must refuse: unclosed quotes, ragged rows, blank
or repeated headers. So exports are read once as untouched records and landed as Parquet
(`land_records`); the checks, the previews and the canonical rows all read the landed table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fill, format_decimal, normalize_header, not_blank, trim_all
from ..operators.labels import text


@dataclass(frozen=True)
class FileLimits:
    """Largest accepted file; None lifts a limit."""

    max_bytes: int | None = None
    max_rows: int | None = None
    max_columns: int | None = None


# Limits of an import preview.
PREVIEW_LIMITS = FileLimits(max_bytes=1_000_000, max_rows=10_000, max_columns=50)

NO_LIMITS = FileLimits()

# A cell is quoted text with doubled quotes inside, or bare text without quotes. Possessive
# quantifiers keep matching linear and off the stack, however long a record is.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_RECORD = rf'^(?:{_QUOTED}|[^",]*+)(?:,(?:{_QUOTED}|[^",]*+))*+$'
_CELL = rf',({_QUOTED}|[^",]*+)'
# A record without line breaks outside quotes; an unclosed quote runs to the end.
_ONE_RECORD = r'(?:\r\n|\n|\r)((?:"[^"]*+(?:"|$)|[^"\r\n]++)*+)'

_OPEN = r'"[^"]*+(?:""[^"]*+)*+'


def _line_patterns(lone: str) -> tuple[str, str]:
    """One line of a file that starts outside or inside of quotes and may end inside. `lone` is the line break
    that the lines were not cut at; outside quotes it counts as the end of a record too.
    """
    cell = rf'(?:{_QUOTED}|[^",{lone}]*+)'
    outside = rf'^(?:{cell}[,{lone}])*+(?:{_OPEN}|{cell})$'
    inside = rf'^[^"]*+(?:""[^"]*+)*+(?:"(?:[,{lone}]{cell})*+(?:(?<=[,{lone}]){_OPEN})?)?$'
    return outside, inside


# Files above this many bytes are read in blocks; the records are the same either way.
SPLIT_ABOVE = 16_000_000

_CSV_NAMES = "*.[cC][sS][vV]"


def read_export(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Accepted exports with one header, as strings or any other schema; bad records in `_bad`."""
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    return (
        spark.read.schema(with_bad)
        .options(
            header=True,
            multiLine=True,
            quote='"',
            escape='"',
            mode="PERMISSIVE",
            columnNameOfCorruptRecord="_bad",
        )
        .csv(paths if isinstance(paths, str) else list(paths))
    )


def _name(file: str) -> Column:
    """The last part of a path as it was given; paths come percent-encoded."""
    return F.url_decode(F.replace(F.substring_index(file, "/", -1), F.lit("+"), F.lit("%2B")))


def listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, name, bytes, modified) of every file; contents are not read.

    Scans skip files of zero bytes. Their names come from the file index of the read, which the
    driver holds for any scan; they have no time of modification.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    scanned = read.select(
        F.col("_metadata.file_path").alias("file"),
        _name("file").alias("name"),
        F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )
    indexed = spark.createDataFrame([(f,) for f in read.inputFiles()], "file string").select(
        F.regexp_replace("file", "^file:/+", "file:/").alias("file")
    )
    empty = indexed.join(scanned.select("file"), "file", "left_anti").select(
        "file",
        _name("file").alias("name"),
        F.lit(0).cast("long").alias("bytes"),
        F.lit(None).cast("timestamp").alias("modified"),
    )
    return scanned.unionByName(empty)


def raw_records(
    spark: SparkSession,
    path: str | list[str],
    max_bytes: int | None = None,
    split_above: int = SPLIT_ABOVE,
    returns: Sequence[str] = (),
    since: dt.datetime | None = None,
) -> DataFrame:
    """(file, pos, raw): the text of each record in file order, blank records left out.

    Files up to `split_above` bytes are read whole, many to a task, and cut into records by one
    expression. Larger files are read in blocks by as many tasks as they need. A file with broken
    quoting is one bad record, a lone quote, in either case. Files over `max_bytes` are pruned before
    reading. `returns` names the large files whose lines end with a carriage return alone (see
    `delivery.return_files`); without it such a file is one line, and one task reads it. Files modified before
    `since` are not opened.
    """
    found = _records_of_texts(_texts(spark, path, max_bytes, split_above, returns, since))
    # outer, as Spark puts a filter before an inner one that would cut and check every text once more
    listed = found.select("file", "block", "row", F.posexplode_outer("kept").alias("part", "raw"))
    return listed.where(F.col("part").isNotNull()).select("file", F.struct("block", "row", "part").alias("pos"), "raw")


def _texts(
    spark: SparkSession,
    path: str | list[str],
    max_bytes: int | None = None,
    split_above: int = SPLIT_ABOVE,
    returns: Sequence[str] = (),
    since: dt.datetime | None = None,
) -> DataFrame:
    """(file, block, row, text): small files whole, large ones by record; see `raw_records`."""
    size = F.col("_metadata.file_size")
    found = {"recursiveFileLookup": True, "pathGlobFilter": _CSV_NAMES}
    whole = spark.read.options(**found).text(path, wholetext=True).where(size <= split_above)
    # names are compared before files are opened
    by_return = F.col("_metadata.file_path").isin(*returns) if returns else F.lit(False)
    cut = {
        end: spark.read.options(**found).text(path, lineSep=end).where((size > split_above) & chosen)
        for end, chosen in (("\n", ~by_return), ("\r", by_return))
        if end == "\n" or returns
    }
    if max_bytes is not None:
        whole, cut = whole.where(size <= max_bytes), {e: d.where(size <= max_bytes) for e, d in cut.items()}
    if since is not None:
        recent = F.col("_metadata.file_modification_time") >= F.lit(since)
        whole, cut = whole.where(recent), {e: d.where(recent) for e, d in cut.items()}
    small = whole.select(
        F.col("_metadata.file_path").alias("file"),
        F.lit(0).cast("long").alias("block"),
        F.lit(0).cast("long").alias("row"),
        F.regexp_replace("value", "^\\x{FEFF}", "").alias("text"),
    )
    texts = small
    if max_bytes is None or max_bytes > split_above:
        for end, lines in cut.items():
            texts = texts.unionByName(_assembled(lines, end))
    return texts


def _records_of_texts(texts: DataFrame) -> DataFrame:
    """(file, block, row, kept, sound): the records of each text; of one with broken quoting a lone quote is kept."""
    # Blank records go first, so that the header of a small file is its part 0. A step each, so that a text is cut and
    # its records are checked once.
    quoted = F.col("text").contains('"').alias("quoted")
    given = texts.select("file", "block", "row", quoted, F.filter(_split("text"), not_blank).alias("given"))
    sound = ~F.col("quoted") | F.forall("given", lambda r: r.rlike(_RECORD))
    checked = given.select("file", "block", "row", "given", sound.alias("sound"))
    kept = F.when(F.col("sound"), F.col("given")).otherwise(F.array(F.lit('"')))
    return checked.select("file", "block", "row", kept.alias("kept"), "sound")


def text_stats(texts: DataFrame) -> DataFrame:
    """What `file_stats` says, from texts as they are read: a row per small file is counted, not a row per record."""
    quote = F.lit('"')

    def width(raw: Column) -> Column:
        pieces = F.size(F.regexp_extract_all(F.concat(F.lit(","), raw), F.lit(_CELL), 1))
        return F.when(raw.contains(quote), pieces).otherwise(F.length(raw) - F.length(F.replace(raw, F.lit(","))) + 1)

    read = _records_of_texts(texts).where(F.size("kept") > 0)
    measured = read.select(
        "file",
        F.struct("block", "row", F.lit(0).alias("part")).alias("pos"),
        F.col("kept")[0].alias("raw"),
        F.size("kept").alias("n"),
        F.transform("kept", width).alias("widths"),
        "sound",
    )
    by_text = measured.select(
        "file", "pos", "raw", "n", F.array_min("widths").alias("low"), F.array_max("widths").alias("high"), "sound"
    )
    stats = by_text.groupBy("file").agg(
        F.sum("n").alias("records"),
        F.min("low").alias("narrowest"),
        F.max("high").alias("widest"),
        F.bool_and("sound").alias("well_quoted"),
        F.min("pos").alias("header_pos"),
        F.min_by("raw", "pos").alias("raw"),
    )
    header = F.transform(_cells(F.col("raw")), trim_all)
    return stats.withColumn("header", F.when(F.col("well_quoted"), header)).drop("raw")


def _split(text: str) -> Column:
    """Cut at line breaks outside quotes, of any kind."""
    pieces = F.regexp_extract_all(F.concat(F.lit("\n"), F.col(text)), F.lit(_ONE_RECORD), 1)
    return (
        F.when(F.col(text).contains('"'), pieces)
        .when(F.col(text).rlike(r"[\r\n]"), F.split(text, r"\r\n|\n|\r"))
        .otherwise(F.array(text))
    )


def _assembled(lines: DataFrame, end: str = "\n") -> DataFrame:
    """(file, block, row, text): lines of large files that were cut at `end`, joined where a quoted cell runs
    over several.

    A line starts inside quotes if the number of quotes before it in the file is odd. That number is
    known from sums per block, so no task needs a whole file. A first pass checks each line for both
    states and shuffles a few numbers per line; a second numbers the records of each block and joins
    their lines. A file with broken quoting is not joined, as a stray quote could make one record of
    most of it; its first line comes back as a bad record.
    """
    value = F.col("value")
    line_outside, line_inside = _line_patterns(r"\r" if end == "\n" else r"\n")
    numbered = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
        (F.regexp_count(value, F.lit('"')) % 2).alias("flips"),
    )
    in_block = Window.partitionBy("file", "block").orderBy("row")
    earlier = in_block.rowsBetween(Window.unboundedPreceding, -1)
    flipped = F.coalesce(F.sum("flips").over(earlier), F.lit(0)) % 2 == 1

    checked = numbered.select(
        "file",
        "block",
        "row",
        "flips",
        value.rlike(line_outside).alias("good_outside"),
        value.rlike(line_inside).alias("good_inside"),
    ).withColumn("flipped", flipped)
    good_if_closed = F.when(F.col("flipped"), F.col("good_inside")).otherwise(F.col("good_outside"))
    good_if_open = F.when(F.col("flipped"), F.col("good_outside")).otherwise(F.col("good_inside"))
    blocks = checked.groupBy("file", "block").agg(
        F.sum("flips").alias("flips"),
        F.bool_and(good_if_closed).alias("good_if_closed"),
        F.bool_and(good_if_open).alias("good_if_open"),
        F.count_if(~F.col("flipped")).alias("records_if_closed"),
        F.count_if("flipped").alias("records_if_open"),
    )
    # From here to the join: one row per block.
    whole_file = Window.partitionBy("file")
    before = whole_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1

    def by_state(name: str) -> Column:
        return F.when(F.col("opened"), F.col(f"{name}_if_open")).otherwise(F.col(f"{name}_if_closed"))

    def latest_start(c: str) -> Column:
        return F.last(F.when(F.col("records") > 0, F.col(c)), ignorenulls=True).over(before)

    states = (
        blocks.withColumn("opened", opened)
        .withColumns({"good": by_state("good"), "records": by_state("records")})
        .select(
            "file",
            "block",
            "opened",
            (F.bool_and("good").over(whole_file) & (F.sum("flips").over(whole_file) % 2 == 0)).alias("sound"),
            (F.col("block") == F.min("block").over(whole_file)).alias("leads"),
            # The record that runs on into this block: its block and its number there.
            latest_start("block").alias("owner"),
            latest_start("records").alias("owner_record"),
        )
    )
    runs_on = F.col("record") == 0
    return (
        numbered.join(states, ["file", "block"])
        .withColumns(
            {
                "starts": (flipped == F.col("opened")).cast("int"),
                "is_first": F.lag("row").over(in_block).isNull(),
            }
        )
        .withColumn("record", F.sum("starts").over(in_block))
        .where(F.col("sound") | (F.col("is_first") & F.col("leads")))
        .select(
            "file",
            F.when(F.col("sound") & runs_on, F.col("owner")).otherwise(F.col("block")).alias("home"),
            F.when(F.col("sound") & runs_on, F.col("owner_record")).otherwise(F.col("record")).alias("record"),
            F.struct("block", "row", F.when(F.col("sound"), value).otherwise('"').alias("value")).alias("line"),
        )
        .groupBy("file", "home", "record")
        .agg(F.sort_array(F.collect_list("line")).alias("lines"))
        .select(
            "file",
            F.col("lines")[0]["block"].alias("block"),
            F.col("lines")[0]["row"].alias("row"),
            F.array_join(F.col("lines")["value"], end).alias("text"),
        )
    )


def _pieces(raw: Column) -> Column:
    """The values of a record as they are written."""
    return F.regexp_extract_all(F.concat(F.lit(","), raw), F.lit(_CELL), 1)


def _unquoted(pieces: Column) -> Column:
    return F.transform(
        pieces,
        lambda c: F.when(
            c.startswith('"'), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(c),
    )


def _cells(raw: Column) -> Column:
    """The unquoted values of a record."""
    return F.when(raw.contains('"'), _unquoted(_pieces(raw))).otherwise(F.split(raw, ","))


def parse_records(records: DataFrame, max_columns: int | None = None) -> DataFrame:
    """(file, pos, cells, n_cells, well_quoted, raw) of `raw_records`: unquoted values; `raw` stays for bad records only.

    Records were checked when texts were cut, so a bad one is the lone quote that stands for a file with broken quoting.
    A record of more than `max_columns` cells has no place in an accepted file, so its cells are counted and, unless it
    may be a header, not kept.
    """
    raw, pieces = F.col("raw"), F.col("pieces")
    commas = F.length("raw") - F.length(F.replace("raw", F.lit(","), F.lit("")))
    # a step of its own, so that a record is cut once
    cut = records.select("file", "pos", "raw", F.when(raw.contains('"'), _pieces(raw)).alias("pieces"))
    parsed = cut.select(
        "file",
        "pos",
        "raw",
        "pieces",
        F.when(pieces.isNotNull(), F.size(pieces)).otherwise(commas + 1).alias("n_cells"),
        (raw != '"').alias("well_quoted"),
    )
    cells = F.when(pieces.isNotNull(), _unquoted(pieces)).otherwise(F.split(raw, ","))
    if max_columns is not None:
        cells = F.when((F.col("n_cells") <= max_columns) | (F.col("pos.part") == 0), cells)
    return parsed.select(
        "file",
        "pos",
        cells.alias("cells"),
        "n_cells",
        "well_quoted",
        F.when(~F.col("well_quoted"), F.col("raw")).alias("raw"),
    )


def land_records(
    spark: SparkSession,
    path: str | list[str],
    out: str,
    limits: FileLimits = NO_LIMITS,
    split_above: int = SPLIT_ABOVE,
    returns: Sequence[str] = (),
) -> DataFrame:
    """Read the exports once, write the parsed records as Parquet and return the landed table.

    `pos` orders the records of a file and only means something within one read, which is why later
    steps take it from the landed table.
    """
    records = raw_records(spark, path, limits.max_bytes, split_above, returns)
    parse_records(records, limits.max_columns).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def file_stats(records: DataFrame) -> DataFrame:
    """One row per file: record count, narrowest and widest record, quoting, header cells.

    A file with broken quoting has no header. Counts are numbers, so their aggregation hashes and sorts no record;
    its map side leaves one row per file and task. Only records that may be a header go through the other one, which
    is one per small file.
    """
    counts = (
        records.select("file", "well_quoted", "n_cells")
        .groupBy("file")
        .agg(
            F.count("*").alias("records"),
            F.min("n_cells").alias("narrowest"),
            F.max("n_cells").alias("widest"),
            F.bool_and("well_quoted").alias("well_quoted"),
        )
    )
    # a part other than the first of its text has the first before it
    headers = (
        records.where(F.col("pos.part") == 0)
        .groupBy("file")
        .agg(F.min("pos").alias("header_pos"), F.min_by("cells", "pos").alias("header"))
    )
    return counts.join(headers, "file").withColumn(
        "header", F.when(F.col("well_quoted"), F.transform("header", trim_all))
    )


def _bad_header(header: Column) -> Column:
    folded = F.transform(header, lambda h: F.lower(h))
    return F.exists(header, lambda h: h == "") | (F.size(F.array_distinct(folded)) < F.size(header))


def _checks(limits: FileLimits) -> dict[str, Column]:
    """Each check of a file beside its statistics, as a condition; the first that holds is the verdict."""

    def above(c: Column, limit: int | None) -> Column:
        return F.lit(False) if limit is None else F.coalesce(c > limit, F.lit(False))

    return {
        "too_long": above(F.col("bytes"), limits.max_bytes),
        "quote_error": ~F.coalesce("well_quoted", F.lit(True)),
        "empty": F.coalesce("records", F.lit(0)) < 2,
        "bad_header": _bad_header(F.col("header")),
        "ragged": F.col("narrowest") != F.col("widest"),
        "too_large": above(F.col("records") - 1, limits.max_rows) | above(F.size("header"), limits.max_columns),
    }


def _having(stats: DataFrame, files: DataFrame, limits: FileLimits, *names: str) -> DataFrame:
    condition = F.lit(False)
    for name in names:
        condition = condition | _checks(limits)[name]
    return files.join(stats, "file", "left").where(condition).select("file")


def file_limits(stats: DataFrame, files: DataFrame, limits: FileLimits) -> DataFrame:
    """Files over a limit."""
    return _having(stats, files, limits, "too_long", "too_large")


def header_check(stats: DataFrame, files: DataFrame) -> DataFrame:
    """Files with an empty or repeated header; case does not tell headers apart."""
    return _having(stats, files, NO_LIMITS, "bad_header")


def ragged_files(stats: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose records differ in their number of cells."""
    return _having(stats, files, NO_LIMITS, "ragged")


def quote_errors(stats: DataFrame, files: DataFrame) -> DataFrame:
    """Files with an unclosed quote, a quote inside a bare cell or text after a closing quote."""
    return _having(stats, files, NO_LIMITS, "quote_error")


def empty_files(stats: DataFrame, files: DataFrame) -> DataFrame:
    """Files without a data row; a file of zero bytes has no record at all, so the listing leads."""
    return _having(stats, files, NO_LIMITS, "empty")


def file_verdict(
    spark: SparkSession,
    path: str | list[str],
    limits: FileLimits = NO_LIMITS,
    split_above: int = SPLIT_ABOVE,
    locale: str | None = None,
    records: DataFrame | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """(file, name, bytes, modified, rows, header, header_pos, verdict[, message]) for every file.

    The verdict is `ok` or the first problem in the order: `type`, `size` in bytes, `format` for
    quotes, `empty`, `headers`, `format` for ragged rows, `size` in rows or columns. A file whose
    quoting is broken has no rows and no header. `records` is the landed table of the same files;
    without it the files are read here. `files` are those to judge, (file, name, bytes, modified), such as
    the new ones of a manifest; without it every file of the folder is listed.
    """
    files = listing(spark, path) if files is None else files.select("file", "name", "bytes", "modified")
    stats = text_stats(_texts(spark, path, limits.max_bytes, split_above)) if records is None else file_stats(records)
    checks = _checks(limits)
    verdict = (
        F.when(~F.lower("name").endswith(".csv"), "type")
        .when(checks["too_long"], "size")
        .when(checks["quote_error"], "format")
        .when(checks["empty"], "empty")
        .when(checks["bad_header"], "headers")
        .when(checks["ragged"], "format")
        .when(checks["too_large"], "size")
        .otherwise("ok")
    )
    out = files.join(stats, "file", "left").select(
        "file",
        "name",
        "bytes",
        "modified",
        F.greatest(F.coalesce(F.col("records"), F.lit(0)) - 1, F.lit(0)).alias("rows"),
        "header",
        F.when(F.col("well_quoted"), F.col("header_pos")).alias("header_pos"),
        verdict.alias("verdict"),
    )
    if locale is None:
        return out
    shown = F.lit(None).cast("string")
    for code, key in VERDICT_TEXT.items():
        message = fill(text(key, locale), _shown(limits, locale)) if code == "size" else text(key, locale)
        shown = F.when(F.col("verdict") == code, message).otherwise(shown)
    return out.withColumn("message", shown)


def _shown(limits: FileLimits, locale: str) -> dict[str, Column]:
    """The limits as the message about size states them."""

    def number(n: int | None) -> Column:
        return text("noLimit", locale) if n is None else format_decimal(F.lit(n), locale)

    size = text("noLimit", locale)
    if limits.max_bytes is not None:
        size = F.lit(f"{limits.max_bytes / 1e6:g} MB")
    return {"size": size, "rows": number(limits.max_rows), "columns": number(limits.max_columns)}


VERDICT_TEXT = {
    "type": "csvType",
    "size": "csvSize",
    "format": "csvError",
    "empty": "csvEmpty",
    "headers": "csvHeaders",
}


def header_cells(verdicts: DataFrame) -> DataFrame:
    """(file, position, header, normalized) of the accepted files."""
    return verdicts.where(F.col("verdict") == "ok").select(
        "file", F.posexplode("header").alias("position", "header")
    ).withColumn("normalized", normalize_header("header"))


def data_records(records: DataFrame, verdicts: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """(file, pos, cells) of the data rows of accepted files; `records` is the landed table. `also` names columns of
    the verdicts that each row gets.
    """
    accepted = verdicts.where(F.col("verdict") == "ok").select("file", "header_pos", *also)
    return (
        records.drop("raw", "well_quoted", "n_cells")
        .join(accepted, "file")
        .where(F.col("pos") > F.col("header_pos"))
        .drop("header_pos")
    )


def preview(records: DataFrame, verdicts: DataFrame, n: int = 5) -> DataFrame:
    """(file, pos, cells, row_no): the first `n` data rows of each accepted file in file order.

    The cut comes before the join, on the landed records with the header: Spark keeps `n` + 1 rows
    per file in each task before anything is shuffled (window group limit).
    """
    w = Window.partitionBy("file").orderBy("pos")
    first = (
        records.select("file", "pos", "cells", F.row_number().over(w).alias("_n"))
        .where(F.col("_n") <= n + 1)
        .withColumn("row_no", F.col("_n") - 1)
        .drop("_n")
    )
    return data_records(first, verdicts)
