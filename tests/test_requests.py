import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from servicelens.operators import kpi
from servicelens.operators import requests as rq
from servicelens.operators.kpi import MEASURES
from servicelens.tables import values_table

SCHEMA = (
    "id bigint, source_id string, category_id string, department_id string, location_id string, "
    "created_at timestamp_ntz, closed_at timestamp_ntz, status string, deadline timestamp_ntz"
)


def make_rows(n=400, seed=7):
    """Requests of which one department holds most, closed early, late, never or before creation."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        created = dt.datetime(2025, 1, 1) + dt.timedelta(hours=rng.randrange(0, 24 * 420))
        closed = None
        if rng.random() < 0.7:
            closed = created + dt.timedelta(hours=rng.randrange(-200, 24 * 120))
        if rng.random() < 0.1:
            closed = created.replace(day=25, hour=0)
        deadline = created + dt.timedelta(days=rng.choice([0, 5, 30, 90]))
        if rng.random() < 0.1:
            deadline = deadline.replace(day=25, hour=0)
        department = "public" if rng.random() < 0.6 else rng.choice(["urban", "social"])
        rows.append(
            (i, f"s{i % 3}", f"c{i % 4}", department, f"l{i % 5}", created, closed, "open" if closed is None else "closed", deadline)
        )
    rows.append((n + 1, "s0", "c0", "far", "l0", dt.datetime(2025, 3, 2), None, "open", dt.datetime(2999, 7, 1)))
    rows.append((n + 2, "s0", "c0", "old", "l0", dt.datetime(2025, 3, 2), None, "open", dt.datetime(1999, 7, 30)))
    rows.append((n, "s0", "c0", "late", "l0", dt.datetime(2025, 6, 30), None, "open", dt.datetime(2025, 7, 1)))
    return rows


def brute_force(rows, n_days):
    def month(t):
        return dt.date(t.year, t.month, 1)

    def following(p):
        return dt.date(p.year + p.month // 12, p.month % 12 + 1, 1)

    seen = [month(t) for r in rows for t in (r[5], r[6]) if t is not None and t.day <= n_days]
    period, last, out = min(seen), max(seen), {}
    while period <= last:
        end = min(period + dt.timedelta(days=n_days), following(period))
        end = dt.datetime(end.year, end.month, end.day)
        start = dt.datetime(period.year, period.month, 1)
        for department in {r[3] for r in rows}:
            mine = [r for r in rows if r[3] == department]
            done = [r for r in mine if r[6] is not None and start <= r[6] < end]
            out[period, department] = (
                sum(start <= r[5] < end for r in mine),
                len(done),
                sum(r[6] <= r[8] for r in done),
                sum(r[8] < end and (r[6] is None or r[6] >= end) for r in mine),
            )
        period = following(period)
    return out


@pytest.mark.parametrize("n_days", [10, 24, 31])
def test_counts_equal_brute_force(spark, n_days):
    rows = make_rows()
    got = {
        (r.period, r.department): tuple(r[m] for m in MEASURES)
        for r in rq.request_kpis(values_table(spark, rows, SCHEMA), n_days).collect()
    }
    assert got == brute_force(rows, n_days)


def test_snapshot_and_reconciliation(spark):
    rows = make_rows(200, 3)
    requests = values_table(spark, rows, SCHEMA)
    expected = {k: v[3] for k, v in brute_force(rows, 24).items() if v[3]}
    got = {(r.period, r.department): r.overdue for r in rq.overdue_snapshot(requests).collect()}
    assert got == expected
    assert kpi.reconcile(kpi.kpis(rq.request_kpis(requests))).count() == 0


def test_one_pass_without_joins(spark):
    """The requests are read once and reduced on the map side; nothing is joined or crossed."""
    requests = spark.range(10).select(
        F.lit("d").alias("department_id"),
        F.lit(dt.datetime(2025, 1, 1)).alias("created_at"),
        F.lit(dt.datetime(2025, 1, 2)).alias("closed_at"),
        F.lit(dt.datetime(2025, 1, 3)).alias("deadline"),
    )
    plan = kpi.growth(kpi.kpis(rq.request_kpis(requests)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 10") == 1
    assert "Join" not in plan and "Cartesian" not in plan
    assert "partial_sum" in plan


def test_deadlines(spark):
    rows = values_table(
        spark, [(1, "c1", dt.datetime(2025, 1, 1, 8)), (2, "c9", dt.datetime(2025, 1, 1))],
        "id bigint, category_id string, created_at timestamp_ntz",
    )
    sla = values_table(spark, [("c1", 10)], "category_id string, sla_days int")
    got = {r.id: r.deadline for r in rq.with_deadline(rows, sla).collect()}
    assert got == {1: dt.datetime(2025, 1, 11, 8), 2: None}


def test_enrich_orphans_zones_and_slices(spark):
    requests = values_table(spark, make_rows(50), SCHEMA)
    places = values_table(
        spark, [(f"l{i}", f"zone{i % 2}", 41.0 + i, 20.0) for i in range(4)], "id string, zone string, lat double, lon double"
    )
    enriched = rq.enrich_requests(requests, locations=places)
    assert enriched.count() == 53 and "location_zone" in enriched.columns
    lost = rq.orphans(requests, places, "location_id")
    assert {r.location_id for r in lost.collect()} == {"l4"} and lost.columns == requests.columns
    zones = {r.zone: r for r in rq.by_zone(requests, places).collect()}
    assert sum(z.requests for z in zones.values()) == 53
    assert zones[None].requests == lost.count() and zones[None].lat is None
    assert zones["zone1"].lat == pytest.approx(43.0)
    assert rq.slice_requests(requests, ["status"]).agg(F.sum("requests")).first()[0] == 53


def test_budget_variance(spark):
    lines = values_table(
        spark,
        [("public", dt.date(2026, 9, 1), 100, 130), ("public", dt.date(2026, 9, 1), 100, 90), ("urban", dt.date(2026, 9, 1), 0, 5)],
        "department_id string, period date, planned decimal(18,2), actual decimal(18,2)",
    )
    got = {r.department: r for r in rq.budget_variance(lines).collect()}
    assert float(got["public"].variance) == 20 and got["public"].variance_pct == 10.0
    assert got["urban"].variance_pct is None
