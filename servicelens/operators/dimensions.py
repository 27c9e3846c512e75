"""Dimensions with history: names of departments and categories that hold for a time.

A version of a dimension row is valid from one day to before another, without end if that is NULL. Rows see the
version of their own time, so a department that was renamed keeps its old name in old months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col


def versions(changes: DataFrame, key: str = "id", since: str = "valid_from") -> DataFrame:
    """`changes` with valid_to: each row holds until the next one of its key.

    Of several rows of a key and day one stays, the first by its other columns.
    """
    rest = [c for c in changes.columns if c not in (key, since)]
    single = changes.groupBy(key, since).agg(F.min(F.struct(*rest)).alias("_rest")).select(key, since, "_rest.*")
    following = F.lead(since).over(Window.partitionBy(key).orderBy(since))
    return single.select(*changes.columns, following.alias("valid_to"))


def overlaps(dimension: DataFrame, key: str = "id") -> DataFrame:
    """The versions that begin before the one ahead of them has ended; rows would see both."""
    order = Window.partitionBy(key).orderBy("valid_from", F.asc_nulls_last("valid_to"))
    end = F.coalesce(F.col("valid_to"), F.lit("9999-12-31").cast("date"))
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = dimension.withColumn("_reach", reach)
    return marked.where(F.col("valid_from") < F.col("_reach")).drop("_reach")


def as_of(rows: DataFrame, dimension: DataFrame, key: str, at: Column | str, prefix: str) -> DataFrame:
    """`rows` with the columns of the version that holds at `at`, named with a prefix; NULL where none does.

    Rows meet the versions of their key, of which one holds; how the join runs is left to the sizes.
    """
    named = dimension.select(
        F.col("id").alias("_id"),
        F.col("valid_from").alias("_from"),
        F.col("valid_to").alias("_to"),
        *[F.col(c).alias(f"{prefix}_{c}") for c in dimension.columns if c not in ("id", "valid_from", "valid_to")],
    )
    day = col(at).cast("date")
    holds = (F.col(key) == F.col("_id")) & (day >= F.col("_from")) & (F.col("_to").isNull() | (day < F.col("_to")))
    return rows.join(named, holds, "left").drop("_id", "_from", "_to")


def enrich_as_of(
    requests: DataFrame,
    departments: DataFrame,
    categories: DataFrame,
    locations: DataFrame,
    sources: DataFrame,
    at: Column | str = "created_at",
) -> DataFrame:
    """Requests with all four dimensions: names of the department and the category as of `at`, the location's zone
    and the source's file. A request that finds nothing stays, with NULLs.
    """
    out = as_of(requests, departments, "department_id", at, "department")
    out = as_of(out, categories, "category_id", at, "category")
    for prefix, dimension in (("location", locations), ("source", sources)):
        renamed = dimension.select(
            F.col("id").alias(f"{prefix}_id"), *[F.col(c).alias(f"{prefix}_{c}") for c in dimension.columns if c != "id"]
        )
        out = out.join(renamed, f"{prefix}_id", "left")
    return out


def localized(df: DataFrame, prefix: str, locale: str, output: str) -> DataFrame:
    """The name of a dimension in one locale; the other locale's, then the key itself, where it is missing."""
    own, other = ("sq", "en") if locale == "sq" else ("en", "sq")
    names = [F.col(f"{prefix}_name_{x}") for x in (own, other)]
    return df.withColumn(output, F.coalesce(*names, F.col(f"{prefix}_id")))
