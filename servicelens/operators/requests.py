"""Requests by row: deadlines, monthly counts, overdue snapshots, enrichment, slices.

A request has `id, source_id, category_id, department_id, location_id, created_at, closed_at,
status` and, once `with_deadline` has run, `deadline`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import DEFAULT_DAYS, effective_month, in_window, month_of
from ..functions.text import col

MEASURES = ("received", "resolved", "on_time", "overdue")
CHANGES = ("received", "resolved", "on_time", "overdue_change")


def with_deadline(requests: DataFrame, sla: DataFrame) -> DataFrame:
    """`deadline = created_at + sla_days`, from `sla(category_id, sla_days)`."""
    days = F.make_interval(days=F.col("sla_days"))
    return (
        requests.join(sla.select("category_id", "sla_days"), "category_id", "left")
        .withColumn("deadline", F.col("created_at") + days)
        .drop("sla_days")
    )


def monthly_changes(requests: DataFrame, n_days: int = DEFAULT_DAYS, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, department, period, CHANGES): counts per department and month, with `overdue_change` in place of
    the overdue level. Changes of different requests add up, so they can be kept and merged.

    Each request turns into at most four small events: received, resolved, one more overdue at the
    deadline, and one less at the later of deadline and closing. One pass over the requests and one
    aggregation whose map side shrinks any department to a row per month, however large it is.
    """
    created, closed, deadline = F.col("created_at"), F.col("closed_at"), F.col("deadline")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def event(month: Column, received=zero, resolved=zero, on_time=zero, change=zero) -> Column:
        return F.struct(
            month.alias("period"),
            received.alias("received"),
            resolved.alias("resolved"),
            on_time.alias("on_time"),
            change.alias("overdue_change"),
        )

    settled = F.when(closed.isNotNull(), F.greatest(deadline, closed))
    events = F.array(
        event(F.when(in_window(created, n_days), month_of(created)), received=one),
        event(
            F.when(in_window(closed, n_days), month_of(closed)),
            resolved=one,
            on_time=F.when(closed <= deadline, one).otherwise(zero),
        ),
        event(effective_month(deadline, n_days), change=one),
        event(effective_month(settled, n_days), change=-one),
    )
    return (
        requests.select(*keys, F.col("department_id").alias("department"), F.inline(events))
        .where(F.col("period").isNotNull())
        .groupBy(*keys, "department", "period")
        .agg(*[F.sum(c).alias(c) for c in CHANGES])
    )


def month_counts(
    requests: DataFrame, start, end=None, measures: Sequence[str] = MEASURES[:3], n_days: int = DEFAULT_DAYS
) -> DataFrame:
    """(period, department, measures) of the months from `start` to `end`, those with events only.

    For questions about few months. Only the events that `measures` need are made, and the range goes
    to their dates: `received` alone reads requests created in it and no closing.
    """
    unknown = set(measures) - set(MEASURES[:3])
    if unknown:
        raise ValueError(f"no count of a month's events: {sorted(unknown)}")
    first, after = F.lit(start), F.add_months(F.lit(start if end is None else end), 1)
    counted = []
    for name, at in (("received", F.col("created_at")), ("resolved", F.col("closed_at"))):
        wanted = [m for m in measures if (m == "received") == (name == "received")]
        if wanted:
            rows = requests.where((at >= first) & (at < after) & in_window(at, n_days))
            late = F.when(F.col("closed_at") <= F.col("deadline"), 1).otherwise(0) if "on_time" in wanted else F.lit(0)
            values = {"received": F.lit(1), "resolved": F.lit(1), "on_time": late}
            counted.append(
                rows.select(
                    F.col("department_id").alias("department"),
                    month_of(at).alias("period"),
                    *[(values[m] if m in wanted else F.lit(0)).cast("long").alias(m) for m in measures],
                )
            )
    rows = counted[0]
    for other in counted[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("period", "department").agg(*[F.sum(m).alias(m) for m in measures])


def request_kpis(requests: DataFrame, n_days: int = DEFAULT_DAYS) -> DataFrame:
    """(period, department, received, resolved, on_time, overdue) for every department and month.

    Received counts by creation, resolved and on time by closing, both inside the first `n_days` of
    a month. Overdue is the level at the end of that window. Months run without gaps from the first
    to the last one with a received or resolved request.
    """
    # From here on the data is one row per department and month.
    everything = Window.partitionBy()
    first, last = (f(active_month()).over(everything) for f in (F.min, F.max))
    return monthly_levels(monthly_changes(requests, n_days), first, last)


def active_month() -> Column:
    """The month of a row of changes if a request was received or resolved in it."""
    return F.when(F.col("received") + F.col("resolved") > 0, F.col("period"))


def monthly_levels(changes: DataFrame, first: Column, last: Column) -> DataFrame:
    """(period, department, MEASURES) of the months from `first` to `last`, from one row of changes per
    department and month with any. The overdue level is the sum of the changes up to a month.
    """
    per_department = Window.partitionBy("department").orderBy("period")
    stretched = changes.withColumns(
        {
            "first_month": first,
            "last_month": last,
            "overdue": F.sum("overdue_change").over(per_department),
            "is_first": F.lag("period").over(per_department).isNull(),
            "next_month": F.lead("period").over(per_department),
        }
    )
    # A row stands for its own month and the empty ones up to the next row; the first row of a
    # department also for the empty ones before it. Months outside the reported range drop out.
    begin = F.greatest(
        "first_month", F.when(F.col("is_first"), F.col("first_month")).otherwise(F.col("period"))
    )
    end = F.least("last_month", F.coalesce(F.add_months("next_month", -1), F.col("last_month")))
    months = F.when(begin <= end, F.sequence(begin, end, F.expr("interval 1 month")))

    def at_own_month(name: str) -> Column:
        return F.when(F.col("month") == F.col("period"), F.col(name)).otherwise(0).cast("long")

    return (
        stretched.withColumn("month", F.explode(months)).select(
            F.col("month").alias("period"),
            "department",
            at_own_month("received").alias("received"),
            at_own_month("resolved").alias("resolved"),
            at_own_month("on_time").alias("on_time"),
            F.when(F.col("month") >= F.col("period"), F.col("overdue"))
            .otherwise(0)
            .cast("long")
            .alias("overdue"),
        )
    )


def overdue_snapshot(requests: DataFrame, n_days: int = DEFAULT_DAYS) -> DataFrame:
    """(period, department, overdue) where requests are past their deadline at the window end.

    Equals the inequality join of requests with month ends (`deadline < end` and not closed before
    `end`), without the join.
    """
    kpis = request_kpis(requests, n_days)
    return kpis.where(F.col("overdue") > 0).select("period", "department", "overdue")


def enrich_requests(
    requests: DataFrame,
    departments: DataFrame | None = None,
    categories: DataFrame | None = None,
    locations: DataFrame | None = None,
    sources: DataFrame | None = None,
) -> DataFrame:
    """Resolve the foreign keys; each dimension has an `id` and its other columns get a prefix."""
    out = requests
    for prefix, dimension in (
        ("department", departments),
        ("category", categories),
        ("location", locations),
        ("source", sources),
    ):
        if dimension is None:
            continue
        key = f"{prefix}_id"
        renamed = dimension.select(
            F.col("id").alias(key),
            *[F.col(c).alias(f"{prefix}_{c}") for c in dimension.columns if c != "id"],
        )
        out = out.join(renamed, key, "left")
    return out


def orphans(requests: DataFrame, dimension: DataFrame, key: str, dimension_key: str = "id") -> DataFrame:
    """Requests whose `key` is missing or has no match in the dimension."""
    known = dimension.select(F.col(dimension_key).alias(key))
    return requests.join(known, key, "left_anti").select(*requests.columns)


def by_zone(requests: DataFrame, locations: DataFrame) -> DataFrame:
    """Requests per location zone, with the mean position of its requests if known.

    Requests are counted per location before the join, so a busy location is one row in it.
    """
    per_location = requests.groupBy(F.col("location_id").alias("id")).agg(F.count("*").alias("n"))
    has_position = {"lat", "lon"} <= set(locations.columns)
    joined = per_location.join(locations, "id", "left")
    means = (
        [
            F.try_divide(
                F.sum(F.col(c) * F.col("n")), F.sum(F.when(F.col(c).isNotNull(), F.col("n")))
            ).alias(c)
            for c in ("lat", "lon")
        ]
        if has_position
        else []
    )
    return joined.groupBy("zone").agg(F.sum("n").alias("requests"), *means)


def slice_requests(requests: DataFrame, dims: Sequence[str | Column]) -> DataFrame:
    return requests.groupBy(*[col(d) for d in dims]).agg(F.count("*").alias("requests"))


def budget_variance(budget: DataFrame, kpis: DataFrame | None = None) -> DataFrame:
    """Planned against actual per department and period, beside that period's KPIs.

    `budget_line(department_id, period, planned, actual)`; several lines per key are summed first.
    """
    lines = budget.groupBy(F.col("department_id").alias("department"), "period").agg(
        F.sum("planned").alias("planned"), F.sum("actual").alias("actual")
    )
    out = lines.withColumn("variance", F.col("actual") - F.col("planned")).withColumn(
        "variance_pct",
        100.0 * F.try_divide(F.col("variance").cast("double"), F.col("planned").cast("double")),
    )
    return out if kpis is None else out.join(kpis, ["department", "period"], "left")
