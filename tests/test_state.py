"""Figures kept by source: equal to a full recount after every delivery, and only what is new is read."""

import datetime as dt
import random

import pytest

from servicelens.operators import requests as rq
from servicelens.operators import state
from servicelens.sources import store

SCHEMA = "id bigint, department_id string, created_at timestamp_ntz, closed_at timestamp_ntz, deadline timestamp_ntz, source_id string"


def rows(rng, source, n, first=0):
    out = []
    for i in range(n):
        created = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 300))
        closed = created + dt.timedelta(hours=rng.randrange(24 * 90)) if rng.random() < 0.6 else None
        deadline = created + dt.timedelta(days=rng.choice([5, 30, 60]))
        out.append((first + i, rng.choice("abc"), created, closed, deadline, source))
    return out


@pytest.fixture
def folders(tmp_path):
    return tuple(str(tmp_path / n) for n in ("requests", "log", "state"))


def deliver(spark, folders, number, given):
    requests, log, _ = folders
    store.write_delivery(spark.createDataFrame(given, SCHEMA), requests, log, number)


def refresh(spark, folders):
    requests, log, kept = folders
    read = store.read_by_source(spark, requests)
    return state.refresh_state(spark, read, store.read_by_source(spark, log), kept)


def figures(df):
    return sorted(map(tuple, df.select("period", "department", *rq.MEASURES).collect()))


def test_equal_to_a_recount_after_every_delivery(spark, folders):
    rng = random.Random(3)
    held = {}
    for number, sources in enumerate([["x", "y"], ["y", "007"], ["x"], ["z"]], 1):
        given = {s: rows(rng, s, 40 if number < 3 else 15, 1000 * number) for s in sources}
        held |= given
        deliver(spark, folders, number, [r for s in sources for r in given[s]])
        assert sorted(refresh(spark, folders)) == sorted(sources)
        everything = spark.createDataFrame([r for g in held.values() for r in g], SCHEMA)
        kept = state.read_state(spark, folders[2])
        assert figures(state.state_kpis(kept)) == figures(rq.request_kpis(everything))
    assert refresh(spark, folders) == []  # nothing is pending


def test_a_source_that_lost_its_requests_leaves_no_figures(spark, folders):
    rng = random.Random(4)
    deliver(spark, folders, 1, rows(rng, "x", 20) + rows(rng, "y", 20))
    refresh(spark, folders)
    # all that is left of y is never counted: created and due beyond the window of its month
    late = dt.datetime(2024, 3, 30)
    deliver(spark, folders, 2, [(1, "a", late, None, None, "y")])
    assert refresh(spark, folders) == ["y"]
    kept = state.read_state(spark, folders[2])
    assert kept.where("source_id = 'y' and period is not null").isEmpty()
    assert refresh(spark, folders) == []


def test_a_delivery_and_a_refresh_can_be_repeated(spark, folders):
    rng = random.Random(5)
    given = rows(rng, "x", 30)
    for _ in range(2):
        deliver(spark, folders, 1, given)
    assert refresh(spark, folders) == ["x"]
    requests, log, kept = folders
    # as if the refresh had been lost: the state of the source is written over
    state.source_state(
        state.delivered_requests(store.read_by_source(spark, requests), ["x"]),
        state.pending_sources(store.read_by_source(spark, log), state.read_state(spark, kept + "-none")),
    ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(kept)
    assert figures(state.state_kpis(state.read_state(spark, kept))) == figures(
        rq.request_kpis(spark.createDataFrame(given, SCHEMA))
    )


def test_only_pending_partitions_are_opened(spark, folders):
    rng = random.Random(6)
    deliver(spark, folders, 1, [r for s in ("x", "y", "z") for r in rows(rng, s, 10)])
    read = store.read_by_source(spark, folders[0])
    chosen = state.delivered_requests(read, ["y"])
    text = rq.monthly_changes(chosen, keys=["source_id"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_id" in text and "= y)" in text
    log = store.read_by_source(spark, folders[1])
    pending = state.pending_sources(log, state.read_state(spark, folders[2]))
    plan = pending._jdf.queryExecution().executedPlan().toString()
    assert "created_at" not in plan


def test_no_task_sees_all_departments_and_months(spark, folders):
    deliver(spark, folders, 1, rows(random.Random(7), "x", 10))
    refresh(spark, folders)
    plan = state.state_kpis(state.read_state(spark, folders[2]))._jdf.queryExecution().sparkPlan().toString()
    windows = [line for line in plan.split("\n") if line.strip(" +-:*").startswith("Window [")]
    assert windows and all("[department" in line for line in windows)


def test_empty_state(spark, folders):
    kept = state.read_state(spark, folders[2])
    assert kept.isEmpty() and state.state_kpis(kept).isEmpty()
