import datetime as dt
import statistics

import pytest

from servicelens.operators import signals
from servicelens.tables import values_table


def series(spark, values, key="a"):
    rows = [(key, dt.date(2026, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return values_table(spark, rows, "k string, day date, value bigint")


def test_spike_is_flagged_and_baseline_needs_a_full_window(spark):
    values = [10, 12, 11, 9, 10, 11, 12, 10, 11, 60, 10, 11]
    rows = signals.signals(series(spark, values), ["k"]).orderBy("day").collect()
    assert [r.is_anomaly for r in rows].index(True) == 9 and sum(r.is_anomaly for r in rows) == 1
    assert all(r.baseline is None and r.z_score is None for r in rows[:7])
    before = values[2:9]
    assert rows[9].baseline == pytest.approx(statistics.mean(before))
    assert rows[9].z_score == pytest.approx((60 - statistics.mean(before)) / statistics.stdev(before))


def test_flat_series_has_no_score(spark):
    rows = signals.signals(series(spark, [5] * 9), ["k"], threshold=1.0).collect()
    assert all(r.z_score is None and not r.is_anomaly for r in rows)


def test_days_without_rows_count_as_zero(spark):
    days = [d for d in range(20) if d not in (12, 13, 14)]
    stamps = [("a", dt.datetime(2026, 1, 1 + d, h)) for d in days for h in range(10)] + [("b", dt.datetime(2026, 1, 5))]
    daily = signals.daily_series(values_table(spark, stamps, "k string, ts timestamp_ntz"), "ts", ["k"])
    rows = signals.signals(daily.where("k = 'a'"), ["k"]).orderBy("day").collect()
    assert [r.value for r in rows] == [0 if d in (12, 13, 14) else 10 for d in range(20)]
    # the first empty day leaves a flat week, so it counts without a score
    assert rows[12].is_anomaly and rows[12].z_score is None and rows[12].deviation == -10
    assert daily.where("k = 'b'").count() == 1


def test_trend_slope(spark):
    rows = signals.trend_slope(series(spark, [2 * i for i in range(9)]), ["k"], window=4).orderBy("day").collect()
    assert [r.slope for r in rows[:3]] == [None] * 3
    assert all(r.slope == pytest.approx(2.0) for r in rows[3:])


def test_series_do_not_mix(spark):
    both = series(spark, [1] * 8).unionByName(series(spark, [100] * 8, "b"))
    assert not any(r.is_anomaly for r in signals.signals(both, ["k"], threshold=0.5).collect())
