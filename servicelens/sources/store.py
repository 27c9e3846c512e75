"""Tables and files written for later steps, other systems and readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_VIEW_ROWS = 1000


def write_canonical(df: DataFrame, path: str, sort_by: str = "created_at") -> None:
    """Write rows by `source_id`; a source delivered again replaces its earlier rows only.

    The rebalance hint lets AQE split a source that holds much of the data over several tasks and
    files, and put small sources together. Rows are sorted inside each file, so later date filters
    skip row groups.
    """
    (
        df.hint("rebalance", "source_id")
        .sortWithinPartitions("source_id", sort_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source_id")
        .parquet(path)
    )


def read_by_source(spark: SparkSession, path: str) -> DataFrame:
    """A table partitioned by source. Sources are text, also where all their names are numbers."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType()) if f.name == "source_id" else f for f in found.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def write_delivery(
    rows: DataFrame, path: str, log_path: str, delivery: int, sort_by: str = "created_at"
) -> None:
    """Write a delivery of some sources, whose earlier rows it replaces, and note it in the log.

    Rows get the number of their delivery. The log, (source_id, delivery, rows), is written last, so a delivery
    that broke off is not in it and can be given again.
    """
    write_canonical(rows.withColumn("delivery", F.lit(delivery).cast("bigint")), path, sort_by)
    written = read_by_source(rows.sparkSession, path).where(F.col("delivery") == delivery)
    noted = written.groupBy("source_id", "delivery").agg(F.count("*").alias("rows"))
    # a number given again replaces its entries
    noted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("delivery").parquet(log_path)


def save_table(df: DataFrame, path: str) -> DataFrame:
    """Write a table that later steps read more than once, and return it as read back.

    It is computed once, survives lost executors, and its size on disk is known to the planner.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_briefing(lines: DataFrame, path: str) -> None:
    """One Markdown text file per period and locale, lines in order."""
    # An empty line sets paragraphs apart; the entries of a list follow each other.
    order = Window.partitionBy("period", "locale").orderBy("line_no", "text")
    before = F.lag("text").over(order)
    follows = F.col("text").startswith("- ") & before.startswith("- ")
    gap = F.when(before.isNull() | follows, "").otherwise("\n")
    (
        lines.select("period", "locale", "line_no", "text", F.concat(gap, F.col("text")).alias("written"))
        .sortWithinPartitions("period", "locale", "line_no", "text")
        .select("period", "locale", F.col("written").alias("text"))
        .write.mode("overwrite")
        .partitionBy("period", "locale")
        .text(path)
    )


def export_metrics(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Hand metric tables to other systems as `parquet`, `json` or `csv`."""
    if fmt not in ("parquet", "json", "csv"):
        raise ValueError(f"unknown export format: {fmt}")
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def read_view(
    spark: SparkSession,
    name: str,
    allowed: Sequence[str],
    columns: Sequence[str] | None = None,
    limit: int | None = MAX_VIEW_ROWS,
    order_by: Sequence[str] = (),
    cut: bool = False,
) -> DataFrame:
    """An allow-listed metric view, of at most `limit` rows (None: all of it).

    A larger view is an error, unless `cut` asks for its first rows by `order_by`.
    """
    if name not in allowed:
        raise ValueError(f"view is not on the allow-list: {name}")
    df = spark.table(name)
    if columns:
        df = df.select(*columns)
    if limit is None:
        return df
    if cut:
        if not order_by:
            raise ValueError("the first rows of a view need an order")
        return df.orderBy(*order_by).limit(limit)
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"view {name} has more than {limit} rows")
    return df
