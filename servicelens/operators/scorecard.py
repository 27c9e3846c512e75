"""Targets, department status and the list of what needs attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fill, month_name
from .kpi import ALL
from .labels import department_name, text

DEFAULT_TARGET = 90.0


def _stale_departments(inventory: DataFrame) -> DataFrame:
    """Department and period with a stale source."""
    keys = ["department", "period"]
    return inventory.where(F.col("stale")).select(*keys).distinct().withColumn("_stale", F.lit(True))


def scorecard(
    kpi: DataFrame,
    targets: DataFrame,
    default: float = DEFAULT_TARGET,
    metric: str = "on_time_rate",
    rank: bool = False,
) -> DataFrame:
    """KPIs beside `targets(department_id, metric, period, target)`, or the default target.

    With `rank` departments get their place of the period, best first; the total has none.
    """
    wanted = targets.where(F.col("metric") == metric).select(
        F.col("department_id").alias("department"), "period", "target"
    )
    out = (
        kpi.join(wanted, ["department", "period"], "left")
        .withColumn("target", F.coalesce(F.col("target"), F.lit(default)))
        .withColumn("meets_target", F.col(metric) >= F.col("target"))
    )
    if rank:
        is_total = F.col("department") == ALL
        place = F.rank().over(Window.partitionBy("period", is_total).orderBy(F.desc(metric)))
        out = out.withColumn("place", F.when(~is_total, place))
    return out


def department_status(card: DataFrame, inventory: DataFrame) -> DataFrame:
    """`stale` wins over the rate; then `on_target` or `below_target`.

    `inventory(period, department, stale)` tells which sources served a month and were behind in it.
    """
    flagged = card.join(_stale_departments(inventory), ["department", "period"], "left")
    is_stale = F.coalesce(F.col("_stale"), F.lit(False))
    return (
        flagged.withColumn(
            "status",
            F.when(is_stale, "stale").when(F.col("meets_target"), "on_target").otherwise("below_target"),
        )
        .withColumn(
            "severity", F.when(is_stale | ~F.col("meets_target"), "warn").otherwise("good")
        )
        .drop("_stale")
    )


def attention(card: DataFrame, inventory: DataFrame) -> DataFrame:
    """(period, department, alert, count, updated, target): what to look at first, per department and for all.

    `overdue_queue` for the largest queue of a period and `stale_source` with the number of stale
    sources. A department without either gets `no_alerts` or `below_target`, and so does `all` in a
    period without any. One pass over the card, which may be costly to compute.
    """
    keys = ["department", "period"]
    stale = inventory.where(F.col("stale")).groupBy(*keys).agg(
        F.count("*").alias("_stale_sources"), F.max("updated").alias("_updated")
    )
    is_total = F.col("department") == ALL
    largest_first = Window.partitionBy("period").orderBy(
        is_total, F.desc("overdue"), F.asc("department")
    )
    whole_period = Window.partitionBy("period")

    def alert(name: Column, count: Column, updated: Column | None = None) -> Column:
        when = F.lit(None).cast("date") if updated is None else updated
        return F.struct(name.alias("alert"), count.cast("long").alias("count"), when.alias("updated"))

    queue, has_stale = F.col("_queue"), F.col("_stale_sources") > 0
    quiet = ~queue & ~has_stale & ~(is_total & F.col("_raised"))
    alerts = F.array(
        F.when(queue, alert(F.lit("overdue_queue"), F.col("overdue"))),
        F.when(has_stale, alert(F.lit("stale_source"), F.col("_stale_sources"), F.col("_updated"))),
        F.when(
            quiet,
            alert(F.when(F.col("meets_target"), "no_alerts").otherwise("below_target"), F.lit(0)),
        ),
    )
    return (
        card.join(stale, keys, "left")
        .withColumn("_stale_sources", F.coalesce("_stale_sources", F.lit(0)))
        .withColumn(
            "_queue", (F.row_number().over(largest_first) == 1) & (F.col("overdue") > 0) & ~is_total
        )
        .withColumn("_raised", F.max(queue | has_stale).over(whole_period))
        .select("period", "department", "target", F.inline(F.array_compact(alerts)))
        .select("period", "department", "alert", "count", "updated", "target")
    )


def attention_text(items: DataFrame, locale: str) -> DataFrame:
    """Adds `title` and `description` of each alert; a missed target is the row's own."""
    goal = fill(text("goal", locale), {"target": F.format_string("%.0f", F.col("target").cast("double"))})
    named = {"department": department_name("department", locale)}
    updated = F.concat_ws(" ", F.dayofmonth("updated"), month_name(F.month("updated"), locale))
    count = {"count": F.col("count")}
    kind = F.col("alert")
    title = (
        F.when(kind == "overdue_queue", fill(text("overdueTitle", locale), count))
        .when((kind == "stale_source") & (F.col("count") == 1), text("staleTitle", locale))
        .when(kind == "stale_source", fill(text("staleTitleMany", locale), count))
        .when(kind == "no_alerts", text("noAlerts", locale))
        .otherwise(text("belowTarget", locale))
    )
    description = (
        F.when(kind == "overdue_queue", fill(text("overdueDescription", locale), named))
        .when(kind == "stale_source", fill(text("staleDescription", locale), {**named, "date": updated}))
        .when(kind == "no_alerts", text("noAlertsDescription", locale))
        .otherwise(goal)
    )
    return items.withColumn("title", title).withColumn("description", description)


def attention_count(items: DataFrame) -> DataFrame:
    """Alerts per period; departments without one do not count."""
    raised = F.col("alert").isin("overdue_queue", "stale_source")
    return items.groupBy("period").agg(F.count_if(raised).alias("alerts"))
