"""Rolling baselines, z-score anomalies and trends over regular series.

A series is already aggregated to one row per key and day (or month), so a key's window holds as
many rows as there are days, however many raw rows went into them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_series(events: DataFrame, ts: str, keys: Sequence[str]) -> DataFrame:
    """(keys, day, value): number of rows per day, 0 on days without rows between a key's first and last."""
    counted = events.where(F.col(ts).isNotNull()).groupBy(*keys, F.col(ts).cast("date").alias("_day")).agg(
        F.count("*").alias("_n")
    )
    following = F.lead("_day").over(Window.partitionBy(*keys).orderBy("_day"))
    until = F.coalesce(F.date_sub(following, 1), F.col("_day"))
    days = counted.select(*keys, "_day", "_n", until.alias("_until"))
    return days.select(*keys, "_day", "_n", F.explode(F.sequence("_day", "_until")).alias("day")).select(
        *keys, "day", F.when(F.col("day") == F.col("_day"), F.col("_n")).otherwise(0).alias("value")
    )


def signals(
    series: DataFrame,
    keys: Sequence[str],
    order: str = "day",
    value: str = "value",
    window: int = 7,
    threshold: float = 3.0,
) -> DataFrame:
    """Adds `baseline`, `deviation`, `z_score` and `is_anomaly`.

    The baseline is the mean of the `window` points before; it is NULL until there are that many.
    The z-score is NULL where those points do not vary; any deviation from them is then an anomaly.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(-window, -1)
    full = F.count(value).over(before) == window
    baseline = F.when(full, F.avg(value).over(before))
    spread = F.when(full, F.stddev_samp(value).over(before))
    return (
        series.withColumn("baseline", baseline)
        .withColumn("spread", spread)
        .withColumn("deviation", F.col(value) - F.col("baseline"))
        .withColumn("z_score", F.try_divide(F.col("deviation"), F.col("spread")))
        .withColumn(
            "is_anomaly",
            F.coalesce(
                F.when(F.col("spread") == 0, F.col("deviation") != 0).otherwise(F.abs("z_score") >= threshold),
                F.lit(False),
            ),
        )
    )


def trend_slope(
    series: DataFrame,
    keys: Sequence[str],
    order: str = "day",
    value: str = "value",
    window: int = 7,
) -> DataFrame:
    """Adds `slope`: least-squares change per day over the last `window` points, this one included."""
    last = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    slope: Column = F.regr_slope(F.col(value).cast("double"), F.unix_date(order).cast("double"))
    return series.withColumn("slope", F.when(F.count(value).over(last) == window, slope.over(last)))


#: Largest p-value of a trend that counts.
ALPHA = 0.05


def _two_sided(z: Column) -> Column:
    """The probability of a normal value at least as far from 0; off by less than 2e-7."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    # Coefficients of a rational approximation of the error function.
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    series = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    return series * F.exp(-x * x)


def trend_test(
    series: DataFrame,
    keys: Sequence[str],
    order: str = "day",
    value: str = "value",
    window: int = 30,
    alpha: float = ALPHA,
) -> DataFrame:
    """(keys, points, s, z, p_value, trend, slope, change_at, change): whether each series rises or falls.

    Mann and Kendall's test on the ranks of the last `window` points, with the variance for ties: `s` counts the
    pairs that rise less those that fall, and `trend` is `up` or `down` where p_value is at most `alpha`, else
    `none`. `slope` is the median of the changes per step over all pairs. The change point is the first point after
    the largest cumulative deviation from the mean; `change` is the mean from there on less the mean before.
    Points without a value do not count. A series needs three points, else its trend is NULL; without a change
    there is no change point.

    A series is one row per point already, and of those only the last `window` meet; no pair becomes a row.
    """
    given = series.where(F.col(value).isNotNull())
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    last = given.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= window)
    point = F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("v"))
    rows = last.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("_points"))
    rows = rows.withColumn("_v", F.transform("_points", lambda p: p["v"])).withColumn("points", F.size("_v"))
    n = F.col("points").cast("double")

    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    later = lambda i: F.slice("_v", i + 2, F.col("points"))
    rises = F.transform("_v", lambda x, i: total(F.transform(later(i), lambda y: F.signum(y - x))))
    ties = F.transform(
        F.array_distinct("_v"), lambda x: F.size(F.filter("_v", lambda y: y == x)).cast("double")
    )
    tied = total(F.transform(ties, lambda t: t * (t - 1) * (2 * t + 5)))
    steps = F.flatten(F.transform("_v", lambda x, i: F.transform(later(i), lambda y, j: (y - x) / (j + 1))))
    rows = rows.withColumns(
        {"s": total(rises), "_variance": (n * (n - 1) * (2 * n + 5) - tied) / 18.0, "_steps": F.array_sort(steps)}
    )
    s, pairs = F.col("s"), F.size("_steps")
    at = lambda i: F.get("_steps", i.cast("int"))
    median = F.when(pairs > 0, (at(F.floor((pairs - 1) / 2)) + at(F.floor(pairs / 2))) / 2)
    z = F.when(F.col("_variance") > 0, (s - F.signum(s)) / F.sqrt("_variance")).otherwise(F.lit(0.0))
    rows = rows.withColumns({"z": z, "slope": median, "_mean": total(F.col("_v")) / n})
    rows = rows.withColumn("p_value", _two_sided(F.col("z")))

    # cumulative deviations; the last is 0 but for rounding
    drift = F.transform("_v", lambda _, i: total(F.slice("_v", F.lit(1), i + 1)) - (i + 1) * F.col("_mean"))
    rows = rows.withColumn("_drift", F.transform(F.slice(drift, F.lit(1), F.col("points") - 1), lambda d: F.round(F.abs(d), 9)))
    largest = F.array_max("_drift")
    rows = rows.withColumn("_at", F.when(largest > 0, F.array_position("_drift", largest).cast("int")))
    mean = lambda values: total(values) / F.size(values)
    before, after = F.slice("_v", F.lit(1), F.col("_at")), F.slice("_v", F.col("_at") + 1, F.col("points"))
    enough = F.col("points") >= 3
    significant = F.col("p_value") <= alpha
    return rows.select(
        *keys,
        "points",
        s.cast("long").alias("s"),
        "z",
        "p_value",
        F.when(enough, F.when(significant & (s > 0), "up").when(significant & (s < 0), "down").otherwise("none")).alias("trend"),
        "slope",
        F.when(F.col("_at").isNotNull(), F.get("_points", F.col("_at"))["at"]).alias("change_at"),
        F.when(F.col("_at").isNotNull(), mean(after) - mean(before)).alias("change"),
    )
