"""Source inventory: what each department delivered, when, and whether it is still fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from ..operators.kpi import ALL, by_department

MAX_AGE_DAYS = 3


def source_inventory(
    rows: DataFrame,
    updated: Column | str,
    department: Column | str = "department_id",
    filename: Column | str | None = None,
    period: Column | str = "period",
) -> DataFrame:
    """(period, id, department, filename, rows, updated) per source and month it serves.

    `rows` carry `source_id`. A source may serve several departments; it then has a line for each.
    """
    file = F.col("source_id") if filename is None else col(filename)
    return (
        rows.select(
            col(period).alias("period"),
            F.col("source_id").alias("id"),
            col(department).alias("department"),
            file.alias("filename"),
            col(updated).cast("date").alias("updated"),
        )
        .groupBy("period", "id", "department", "filename")
        .agg(F.count("*").alias("rows"), F.max("updated").alias("updated"))
    )


def file_inventory(verdicts: DataFrame, department: Column, period: Column | None = None) -> DataFrame:
    """The same for accepted files, by file name and modification time; no row is read.

    A file serves the month it was uploaded in unless `period` says otherwise.
    """
    served = F.trunc("modified", "month") if period is None else period
    return verdicts.where(F.col("verdict") == "ok").select(
        served.alias("period"),
        F.col("name").alias("id"),
        department.alias("department"),
        F.col("name").alias("filename"),
        "rows",
        F.col("modified").cast("date").alias("updated"),
    )


def stale_sources(inventory: DataFrame, as_of, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Adds `stale`: last updated more than `max_age_days` before `as_of`, a date or a column such as
    the end of the month that a source serves.
    """
    age = F.datediff(as_of if isinstance(as_of, Column) else F.lit(as_of), F.col("updated"))
    return inventory.withColumn("stale", age > max_age_days)


def sources_for(inventory: DataFrame, department: str = ALL) -> DataFrame:
    return by_department(inventory, department)


def source_count(inventory: DataFrame) -> DataFrame:
    """Sources per period and department, and `all` for the distinct ones of a period."""
    return (
        inventory.groupingSets([["period", "department"], ["period"]], "period", "department")
        .agg(F.count_distinct("id").alias("sources"), F.grouping("department").alias("_is_total"))
        .withColumn("department", F.when(F.col("_is_total") == 1, ALL).otherwise(F.col("department")))
        .drop("_is_total")
    )
