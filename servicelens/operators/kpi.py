"""KPIs over `metrics(period, department, received, resolved, on_time, overdue)`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import DEFAULT_DAYS, in_window
from ..functions.text import col, round_half_up
from .requests import MEASURES

ALL = "all"

# Shares of a total per department; the last department takes the remainder.
WEIGHTS = (("public", 0.39), ("urban", 0.25), ("social", 0.21), ("finance", None))


def by_department(df: DataFrame, department: str, column: str = "department") -> DataFrame:
    """One department; `all` keeps every row."""
    return df if department == ALL else df.where(F.col(column) == department)


def by_period(df: DataFrame, period, cumulative: bool = False, column: str = "period") -> DataFrame:
    """Exactly one period, or every period up to it."""
    at = F.lit(period)
    return df.where(F.col(column) <= at if cumulative else F.col(column) == at)


def clip_month(df: DataFrame, ts: str, n_days: int = DEFAULT_DAYS, start=None, end=None) -> DataFrame:
    """The first `n_days` of each month; `start` and `end` (exclusive) prune the scan."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(ts) < F.lit(end))
    return df.where(in_window(ts, n_days))


def on_time_rate(on_time: Column | str, resolved: Column | str) -> Column:
    """Percent; 0 when nothing was resolved."""
    return F.coalesce(_percent(on_time, resolved), F.lit(0.0))


def _percent(part: Column | str, whole: Column | str) -> Column:
    return 100.0 * F.try_divide(col(part).cast("double"), col(whole).cast("double"))


def kpis(metrics: DataFrame, total: bool = True) -> DataFrame:
    """Sums and the on-time rate per period and department, and per period over all of them.

    The rate is a ratio of sums, never a mean of rates.
    """
    sums = [F.sum(m).cast("long").alias(m) for m in MEASURES]
    if total:
        grouped = metrics.groupingSets(
            [["period", "department"], ["period"]], "period", "department"
        ).agg(*sums, F.grouping("department").alias("_is_total"))
        summed = grouped.withColumn(
            "department", F.when(F.col("_is_total") == 1, ALL).otherwise(F.col("department"))
        ).drop("_is_total")
    else:
        summed = metrics.groupBy("period", "department").agg(*sums)
    return summed.withColumn("on_time_rate", on_time_rate("on_time", "resolved"))


def growth(kpi: DataFrame) -> DataFrame:
    """Change against the previous period: received in percent, the rate in percentage points."""
    w = Window.partitionBy("department").orderBy("period")
    before = F.lag("received").over(w)
    return kpi.withColumn(
        "received_growth", 100.0 * (F.try_divide(F.col("received").cast("double"), before.cast("double")) - 1)
    ).withColumn("rate_change", F.col("on_time_rate") - F.lag("on_time_rate").over(w))


def share(kpi: DataFrame, measure: str = "overdue") -> DataFrame:
    """Percent of a period's total that each department holds; NULL where the total is 0."""
    parts = kpi.where(F.col("department") != ALL)
    total = F.sum(measure).over(Window.partitionBy("period"))
    return parts.withColumn(f"{measure}_share", _percent(F.col(measure), total))


def q_overdue(metrics: DataFrame, period=None) -> DataFrame:
    """The department with most overdue requests; by name when two tie."""
    df = metrics if period is None else by_period(metrics, period)
    per_department = df.groupBy("department").agg(F.sum("overdue").cast("long").alias("overdue"))
    return per_department.orderBy(F.desc("overdue"), F.asc("department")).limit(1)


def top_overdue(metrics: DataFrame) -> DataFrame:
    """`q_overdue` for every period at once; keeps the other columns."""
    w = Window.partitionBy("period").orderBy(F.desc("overdue"), F.asc("department"))
    parts = metrics.where(F.col("department") != ALL)
    return parts.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def q_performance(metrics: DataFrame, period=None) -> DataFrame:
    """On-time percent over all departments; NULL when nothing was resolved."""
    df = metrics if period is None else by_period(metrics, period)
    return df.agg(F.sum("on_time").alias("o"), F.sum("resolved").alias("r")).select(
        _percent("o", "r").alias("on_time_percent")
    )


def q_volume(metrics: DataFrame, period=None) -> DataFrame:
    df = metrics if period is None else by_period(metrics, period)
    return df.agg(F.sum("received").cast("long").alias("total_requests"))


def reconcile(kpi: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Periods and measures whose departments do not add up to the total; empty when all do."""
    is_total = F.col("department") == ALL
    return (
        kpi.unpivot(["period", "department"], list(measures), "measure", "value")
        .groupBy("period", "measure")
        .agg(
            F.coalesce(F.sum(F.when(~is_total, F.col("value"))), F.lit(0)).alias("parts"),
            F.sum(F.when(is_total, F.col("value"))).alias("total"),
        )
        .where(~F.col("parts").eqNullSafe(F.col("total")))
    )


def allocate(
    totals: DataFrame,
    measures: Sequence[str],
    weights: Sequence[tuple[str, float | None]] = WEIGHTS,
) -> DataFrame:
    """Split totals by fixed weights so that the parts always add up to the total.

    Each part is rounded half up; the last department takes what is left. The weights are literals,
    so this is a map over the totals.
    """
    *weighted, (last, _) = weights
    rounded = {
        m: [(dept, round_half_up(F.col(m) * F.lit(w))) for dept, w in weighted] for m in measures
    }
    rows = []
    for i, dept in enumerate([d for d, _ in weighted] + [last]):
        fields = [F.lit(dept).alias("department")]
        for m in measures:
            if i < len(weighted):
                part = rounded[m][i][1]
            else:
                part = F.col(m)
                for _, taken in rounded[m]:
                    part = part - taken
            fields.append(part.cast("long").alias(m))
        rows.append(F.struct(*fields))
    keys = [c for c in totals.columns if c not in measures]
    return totals.select(*keys, F.inline(F.array(*rows)))


def trend(
    history: DataFrame,
    metrics: DataFrame,
    department: str = ALL,
    period=None,
    weights: Sequence[tuple[str, float | None]] = WEIGHTS,
) -> DataFrame:
    """Received and resolved per period: allocated city totals, then measured periods.

    `history(period, received, resolved)` holds city totals; measured periods after `period` are
    left out.
    """
    measures = ["received", "resolved"]
    measured = metrics if period is None else by_period(metrics, period, cumulative=True)
    if department == ALL:
        early = history.select("period", *measures)
    else:
        early = by_department(allocate(history, measures, weights), department).select("period", *measures)
    late = (
        by_department(measured.where(F.col("department") != ALL), department)
        .groupBy("period")
        .agg(*[F.sum(m).cast("long").alias(m) for m in measures])
    )
    return (
        early.unionByName(late)
        .select(F.lit(department).alias("department"), "period", *measures)
        .orderBy("period")
    )


def chart_series(series: DataFrame) -> DataFrame:
    """One row per point of the two chart lines."""
    ids = [c for c in series.columns if c not in ("received", "resolved")]
    return series.unpivot(ids, ["received", "resolved"], "measure", "value")


def latest(series: DataFrame, order: str = "period", by: Sequence[str] = ("department",)) -> DataFrame:
    """The last point of each series."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return series.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
