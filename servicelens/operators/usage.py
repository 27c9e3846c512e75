"""Ledger of calls to a priced text service: outcome, cost, spend and budget gate.

`usage(call_id, model, input_tokens, output_tokens, ok, refusal)`; `call_id`, or whatever columns are
named instead, is unique and gives the order of the calls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staging_path
from ..sources.store import save_table
from ..tables import values_table

# USD per one million input and output tokens; an unknown model costs as `smart`.
PRICES = (("fast", 1.0, 5.0), ("smart", 2.0, 10.0))
DEFAULT_MODEL = "smart"
DEFAULT_BUDGET = 20.0

# Outcome codes of a call; an error code ends in its cause.
OUTCOMES = {
    "unavailable": "llm_unavailable",
    "budget": "llm_budget_exhausted",
    "error": "llm_error:",
    "refusal": "llm_refusal",
}

def price_table(spark: SparkSession) -> DataFrame:
    return values_table(spark, PRICES, "model string, in_usd double, out_usd double")


def price_usage(usage: DataFrame, prices: DataFrame, default: tuple[float, float] = PRICES[1][1:]) -> DataFrame:
    """Adds `cost_usd`. Failed calls cost nothing, refused ones cost as usual."""
    priced = usage.join(prices.select("model", "in_usd", "out_usd"), "model", "left")
    cost = (
        F.col("input_tokens") * F.coalesce("in_usd", F.lit(default[0]))
        + F.col("output_tokens") * F.coalesce("out_usd", F.lit(default[1]))
    ) / F.lit(1e6)
    charged = F.col("ok") | F.coalesce("refusal", F.lit(False))
    return priced.withColumn("cost_usd", F.when(charged, cost).otherwise(0.0)).drop("in_usd", "out_usd")


def spend(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens and cost per model; of a gated ledger those that were let through."""
    gated = "allowed" in usage.columns
    priced = usage.where("allowed") if gated else price_usage(usage, prices)
    return priced.groupBy("model").agg(
        F.count("*").alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
    )


def running_total(
    df: DataFrame, value: str, order: Sequence[str], output: str, decimals: int = 10
) -> DataFrame:
    """Adds the sum of `value` over all rows before this one in the order of `order`, which is unique.

    A plain window would put every row into one task. Here the rows are range-partitioned by their
    order and written once with the number of their partition; a window runs inside each partition,
    and the sums of earlier ones (a row per partition) are added. The number of partitions is that of
    any shuffle. Sums are decimal: they do not depend on the order in which partial sums arrive.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())
    ranged = ranged.withColumn("_exact", F.col(value).cast(f"decimal(38,{decimals})"))
    sliced = save_table(ranged, staging_path(spark, "running-total"))
    before = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = sliced.groupBy("_slice").agg(F.sum("_exact").alias("_sum")).select(
        "_slice",
        F.sum("_sum")
        .over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
        .alias("_earlier"),
    )
    zero = F.lit(0).cast(f"decimal(38,{decimals})")
    return (
        sliced.withColumn("_inside", F.coalesce(F.sum("_exact").over(before), zero))
        .join(earlier, "_slice")
        .withColumn(output, (F.coalesce("_earlier", zero) + F.col("_inside")).cast("double"))
        .drop("_slice", "_exact", "_inside", "_earlier")
    )


def budget_gate(
    usage: DataFrame,
    prices: DataFrame,
    budget: float = DEFAULT_BUDGET,
    order: Sequence[str] = ("call_id",),
) -> DataFrame:
    """Adds `cost_usd`, `spent_before` and `allowed`: a call is blocked once the spend reaches the budget.

    A blocked call costs nothing, so the spend stays what the allowed calls cost. Costs are never
    negative and a blocked call stays blocked: the running total of all earlier calls decides the same
    way, and its smallest value at or above the budget is the final spend.
    """
    limit = F.lit(float(budget))
    total = running_total(price_usage(usage, prices), "cost_usd", order, "spent_before")
    allowed = F.col("spent_before") < limit
    final = total.where(~allowed).agg(F.min("spent_before").alias("_final"))
    return (
        total.withColumn("allowed", allowed)
        .withColumn("cost_usd", F.when(F.col("allowed"), F.col("cost_usd")).otherwise(0.0))
        .withColumn(
            "spent_before", F.when(F.col("allowed"), F.col("spent_before")).otherwise(final.scalar())
        )
    )


def call_outcome(
    available: Column,
    allowed: Column,
    failure: Column,
    refusal: Column,
) -> Column:
    """Outcome code of one call; NULL for success.

    `failure` is NULL, `rate_limited`, `connection`, an HTTP status as text, or anything else, which
    reads as unexpected.
    """
    known = failure.isin("rate_limited", "connection") | failure.rlike("^[0-9]{3}$")
    return (
        F.when(~available, OUTCOMES["unavailable"])
        .when(~allowed, OUTCOMES["budget"])
        .when(known, F.concat(F.lit(OUTCOMES["error"]), failure))
        .when(failure.isNotNull(), OUTCOMES["error"] + "unexpected")
        .when(refusal, OUTCOMES["refusal"])
    )
