"""Canonical requests and related tables over a star schema of orders.

An order is a request: its customer's segment is the department, its priority the category, the
customer's nation the location and the region the source. It is closed by the last shipment of its
lines once the order is finished.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.requests import with_deadline
from ..tables import values_table

SLA_DAYS = (
    ("1-URGENT", 180),
    ("2-HIGH", 365),
    ("3-MEDIUM", 730),
    ("4-NOT SPECIFIED", 1095),
    ("5-LOW", 1460),
)


# Names of departments and categories with the day from which they hold; a department without a version for a day has
# no name then.
NAMES = "id string, name_sq string, name_en string, valid_from date"
DEPARTMENTS = (
    ("AUTOMOBILE", "Transporti", "Transport", dt.date(1990, 1, 1)),
    ("BUILDING", "Ndërtimi", "Construction", dt.date(1990, 1, 1)),
    ("BUILDING", "Zhvillimi urban", "Urban development", dt.date(1998, 1, 1)),
    ("BUILDING", None, "Urban planning", dt.date(2000, 6, 15)),
    ("FURNITURE", "Pasuritë", "Assets", dt.date(1996, 3, 1)),
    ("HOUSEHOLD", "Shërbimet sociale", "Social services", dt.date(1990, 1, 1)),
)
CATEGORIES = (
    ("1-URGENT", "urgjente", "urgent", dt.date(1990, 1, 1)),
    ("2-HIGH", "e lartë", "high", dt.date(1990, 1, 1)),
    ("2-HIGH", "e lartë", "priority", dt.date(1999, 1, 1)),
    ("3-MEDIUM", "mesatare", None, dt.date(1990, 1, 1)),
    ("5-LOW", "e ulët", "low", dt.date(1990, 1, 1)),
)


# Declared, so that no job has to read file footers before a query can be planned.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}.parquet")


def locations(spark: SparkSession, path: str) -> DataFrame:
    """(id, zone)"""
    nation, region = table(spark, path, "nation"), table(spark, path, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("id"), F.col("r_name").alias("zone")
    )


def customers(spark: SparkSession, path: str) -> DataFrame:
    """(c_custkey, c_nationkey, department_id)"""
    return table(spark, path, "customer").select(
        "c_custkey", "c_nationkey", F.col("c_mktsegment").alias("department_id")
    )


def status() -> Column:
    """The status of a request from that of its order."""
    return (
        F.when(F.col("o_orderstatus") == "F", "closed")
        .when(F.col("o_orderstatus") == "P", "in_progress")
        .otherwise("open")
    )


def requests(
    spark: SparkSession, path: str, located: bool = False, closings: bool = True
) -> DataFrame:
    """Canonical requests with their deadline.

    Leave out what a query does not need: `located` adds the source and the location, `closings` the
    closing time, which costs the aggregation of the order lines.
    """
    orders = table(spark, path, "orders").select(
        F.col("o_orderkey").alias("id"),
        "o_custkey",
        F.col("o_orderpriority").alias("category_id"),
        F.col("o_orderdate").alias("created_at"),
        status().alias("status"),
    )
    if closings:
        # Grouped by the join key, so the aggregation's shuffle also serves the join.
        last_shipment = (
            table(spark, path, "lineitem")
            .groupBy(F.col("l_orderkey").alias("id"))
            .agg(F.max("l_shipdate").alias("_shipped"))
        )
        orders = (
            orders.join(last_shipment, "id", "left")
            .withColumn("closed_at", F.when(F.col("status") == "closed", F.col("_shipped")))
            .drop("_shipped")
        )
    joined = orders.join(
        customers(spark, path), F.col("o_custkey") == F.col("c_custkey"), "left"
    )
    if located:
        # Names come after the large join, so its shuffles carry only keys.
        nation, region = table(spark, path, "nation"), table(spark, path, "region")
        joined = (
            joined.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .withColumnsRenamed({"n_name": "location_id", "r_name": "source_id"})
            .drop("n_nationkey", "n_regionkey", "r_regionkey")
        )
    joined = joined.drop("o_custkey", "c_custkey", "c_nationkey")
    sla = values_table(spark, SLA_DAYS, "category_id string, sla_days int")
    return with_deadline(joined, sla)


def usage(spark: SparkSession, path: str) -> DataFrame:
    """Call ledger in the order (conv_id, turn): every assistant turn is a call, text lengths stand for tokens.

    The shortest answers stand for refusals and the longest for failures, so every outcome occurs.
    """
    turns = table(spark, path, "conversations")
    length = F.length("text").cast("long")
    per_turn = turns.where(F.col("role") == "assistant").select(
        "conv_id",
        "turn",
        F.when(F.col("turn") == 1, "fast").when(F.col("turn") == 3, "smart").otherwise("other").alias("model"),
        (length * 10).alias("input_tokens"),
        length.alias("output_tokens"),
        F.when(length > 1700, "rate_limited")
        .when(length > 1600, "503")
        .when(length > 1500, "timeout")
        .alias("failure"),
        (length < 150).alias("refusal"),
    )
    return per_turn.withColumn("ok", F.col("failure").isNull() & ~F.col("refusal")).withColumn(
        "refusal", F.col("failure").isNull() & F.col("refusal")
    )
