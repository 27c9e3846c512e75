import datetime as dt

import pytest
from pyspark.sql import functions as F

from servicelens.operators import kpi, scorecard
from servicelens.sources import inventory as inv
from servicelens.tables import values_table

from . import fixtures as fx

DEPARTMENTS = ["public", "urban", "social", "finance"]
TARGETS = "department_id string, metric string, period date, target double"


@pytest.fixture(scope="module")
def monthly(spark):
    rows = kpi.growth(kpi.kpis(fx.metrics(spark))).collect()
    return {(r.period, r.department): r for r in rows}


def test_totals_and_weighted_rate(monthly):
    total = monthly[fx.SEP, "all"]
    assert (total.received, total.resolved, total.on_time, total.overdue) == (1248, 1136, 993, 42)
    assert total.on_time_rate == 993 / 1136 * 100
    assert sum(monthly[fx.SEP, d].received for d in DEPARTMENTS) == total.received
    assert monthly[fx.AUG, "all"].received == 1182


@pytest.mark.parametrize(
    "department, rate, growth, change",
    [
        ("all", 87.4, 5.6, 3.2),
        ("public", 78.1, 6.1, 3.7),
        ("urban", 87.9, 4.0, 4.4),
        ("social", 97.3, 5.6, 3.6),
        ("finance", 94.4, 6.9, -1.2),
    ],
)
def test_september_against_august(monthly, department, rate, growth, change):
    row = monthly[fx.SEP, department]
    assert round(row.on_time_rate, 1) == rate
    assert round(row.received_growth, 1) == growth
    assert round(row.rate_change, 1) == change
    assert monthly[fx.AUG, department].received_growth is None


def test_filters(spark):
    metrics = fx.metrics(spark)
    public = kpi.by_period(kpi.by_department(metrics, "public"), fx.SEP).collect()
    assert [r.overdue for r in public] == [28]
    assert kpi.by_department(metrics, "all").count() == 8
    assert kpi.by_period(metrics, fx.SEP, cumulative=True).count() == 8


def test_zero_denominators_differ(spark):
    nothing = values_table(
        spark,
        [(fx.SEP, "public", 3, 0, 0, 0)],
        "period date, department string, received bigint, resolved bigint, on_time bigint, overdue bigint",
    )
    assert {r.on_time_rate for r in kpi.kpis(nothing).collect()} == {0.0}
    assert kpi.q_performance(nothing).first().on_time_percent is None
    assert kpi.share(nothing).first().overdue_share is None
    grown = kpi.growth(kpi.kpis(nothing.unionByName(nothing.withColumn("period", F.lit(fx.AUG)).withColumn("received", F.lit(0)))))
    assert all(r.received_growth is None for r in grown.collect())


def test_questions(spark):
    metrics = fx.metrics(spark)
    assert tuple(kpi.q_overdue(metrics, fx.SEP).first()) == ("public", 28)
    assert kpi.q_volume(metrics, fx.SEP).first().total_requests == 1248
    assert kpi.q_performance(metrics, fx.SEP).first().on_time_percent == pytest.approx(993 / 1136 * 100)
    shares = {r.department: r.overdue_share for r in kpi.share(kpi.by_period(metrics, fx.SEP)).collect()}
    assert round(shares["public"], 1) == 66.7
    tops = {r.period: r.department for r in kpi.top_overdue(metrics).collect()}
    assert tops == {fx.SEP: "public", fx.AUG: "public"}


def test_top_ties_go_by_name(spark):
    tied = fx.metrics(spark).withColumn("overdue", F.lit(5).cast("long"))
    assert kpi.q_overdue(tied, fx.SEP).first().department == "finance"


def test_allocation_values_and_remainder(spark):
    rows = kpi.allocate(fx.history(spark), ["received", "resolved"]).collect()
    got = {(r.period.month, r.department): (r.received, r.resolved) for r in rows}
    expected = {
        4: ([349, 224, 188, 133], [324, 208, 174, 124]),
        5: ([374, 240, 201, 143], [344, 220, 185, 132]),
        6: ([406, 260, 218, 156], [377, 242, 203, 144]),
        7: ([386, 248, 208, 148], [376, 241, 203, 145]),
    }
    for month, (received, resolved) in expected.items():
        assert [got[month, d] for d in DEPARTMENTS] == list(zip(received, resolved))


@pytest.mark.parametrize("period", [fx.AUG, fx.SEP])
def test_trend_reconciles_every_month(spark, period):
    def series(department):
        out = kpi.trend(fx.history(spark), fx.metrics(spark), department, period)
        return [(r.period, r.received, r.resolved) for r in out.collect()]

    total = series("all")
    parts = [series(d) for d in DEPARTMENTS]
    assert [p for p, _, _ in total] == sorted(p for p, _, _ in total)
    assert total[-1][0] == period and len(total) == (6 if period == fx.SEP else 5)
    for i, (_, received, resolved) in enumerate(total):
        assert sum(p[i][1] for p in parts) == received
        assert sum(p[i][2] for p in parts) == resolved


def test_trend_end_and_chart_series(spark):
    series = kpi.trend(fx.history(spark), fx.metrics(spark), "public", fx.SEP)
    assert kpi.latest(series).first().received == 486
    long = kpi.chart_series(series)
    assert long.count() == 12
    assert {r.measure for r in long.collect()} == {"received", "resolved"}


def test_reconcile_finds_a_wrong_total(spark):
    table = kpi.kpis(fx.metrics(spark))
    assert kpi.reconcile(table).count() == 0
    wrong = table.withColumn(
        "resolved", F.when((F.col("department") == "urban") & (F.col("period") == fx.SEP), 1).otherwise(F.col("resolved"))
    )
    assert [(r.period, r.measure) for r in kpi.reconcile(wrong).collect()] == [(fx.SEP, "resolved")]


def _card(spark, targets=()):
    table = kpi.by_period(kpi.kpis(fx.metrics(spark)), fx.SEP)
    return scorecard.scorecard(table, values_table(spark, targets, TARGETS), rank=True)


def test_department_status(spark):
    stale = inv.stale_sources(fx.inventory(spark), fx.AS_OF)
    status = {r.department: (r.status, r.severity) for r in scorecard.department_status(_card(spark), stale).collect()}
    assert status["public"] == ("below_target", "warn")
    assert status["urban"] == ("stale", "warn")
    assert status["social"] == status["finance"] == ("on_target", "good")


def test_targets_override_the_default(spark):
    card = _card(spark, [("public", "on_time_rate", fx.SEP, 75.0), ("public", "other", fx.SEP, 99.0)])
    rows = {r.department: r for r in card.collect()}
    assert rows["public"].meets_target and rows["public"].target == 75.0
    assert rows["urban"].target == 90.0 and not rows["urban"].meets_target
    assert {d: r.place for d, r in rows.items()} == {"social": 1, "finance": 2, "urban": 3, "public": 4, "all": None}
    calm = inv.stale_sources(fx.inventory(spark), fx.SEP)
    goals = scorecard.attention_text(scorecard.attention(_card(spark, [("urban", "on_time_rate", fx.SEP, 95.0)]), calm), "en")
    assert {r.department: r.description for r in goals.collect()}["urban"] == "Target: 95% on time"


def test_attention(spark):
    stale = inv.stale_sources(fx.inventory(spark), fx.AS_OF)
    items = scorecard.attention(_card(spark), stale)
    got = {(r.department, r.alert, r["count"]) for r in items.collect()}
    assert got == {
        ("public", "overdue_queue", 28),
        ("urban", "stale_source", 1),
        ("social", "no_alerts", 0),
        ("finance", "no_alerts", 0),
    }
    assert scorecard.attention_count(items).first().alerts == 2
    shown = {r.department: (r.title, r.description) for r in scorecard.attention_text(items, "en").collect()}
    assert shown["public"] == (
        "28 requests past their deadline", "Public services has the largest overdue queue in this period.",
    )
    assert shown["urban"] == (
        "One source is out of date", "Urban planning was last updated on 18 September.",
    )
    assert shown["social"] == (
        "No priority exceptions", "This department is meeting its service target.",
    )


def test_sources_count_in_their_month_only(spark):
    earlier = inv.stale_sources(fx.inventory(spark), fx.AS_OF).withColumn("period", F.add_months("period", -1))
    status = {r.department: r.status for r in scorecard.department_status(_card(spark), earlier).collect()}
    assert status["urban"] == "below_target" and "stale" not in status.values()
    alerts = {r.alert for r in scorecard.attention(_card(spark), earlier).collect()}
    assert alerts == {"overdue_queue", "no_alerts", "below_target"}


def test_attention_falls_back_to_the_city(spark):
    calm = _card(spark).withColumn("overdue", F.lit(0).cast("long"))
    fresh = inv.stale_sources(fx.inventory(spark), dt.date(2026, 9, 18))
    got = {(r.department, r.alert) for r in scorecard.attention(calm, fresh).collect()}
    assert ("all", "below_target") in got and ("urban", "below_target") in got
    assert scorecard.attention_count(scorecard.attention(calm, fresh)).first().alerts == 0
