"""What the plans look like: single scans, pruned columns, pushed filters, no crossed rows."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from servicelens.plans.oracle import ORACLE
from servicelens.plans.queries import QUERIES

TABLES = "/root/testdata/sf0.001"
# These write and read files while they are built.
WRITERS = {"ingest_verdict", "ingest_canonical", "ingest_errors", "source_lineage", "reused_mapping", "import_preview", "mapping_proposal", "briefing_files", "exported_metrics"}

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables are not here")


def test_statuses_are_counted_before_the_join(spark):
    text = plan(spark, "localized_status")
    assert "customer" not in text and "ReadSchema: struct<o_orderstatus:string>" in text


def plan(spark, name):
    return queries()[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_no_crossed_rows_and_no_python(spark, name):
    text = plan(spark, name)
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Scan ExistingRDD"):
        assert unwanted not in text, unwanted


@pytest.mark.parametrize("name", ["kpi_monthly", "kpi_growth", "scorecard_ranked", "ask_answers", "display_text"])
def test_requests_are_read_once(spark, name):
    text = plan(spark, name)
    assert text.count("FileScan parquet") == 3
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in text
    assert "partial_max(l_shipdate" in text


def test_alerts_read_the_card_once(spark):
    # Three scans for the card, four for the inventory.
    assert plan(spark, "attention").count("FileScan parquet") == 7
    assert plan(spark, "briefing_facts").count("FileScan parquet") == 7


def test_filters_reach_the_scans(spark):
    text = plan(spark, "kpi_one_department")
    assert "EqualTo(c_mktsegment,BUILDING)" in text
    text = plan(spark, "request_volume")
    assert "lineitem" not in text and "l_orderkey" not in text
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate,2000-09-01" in text


def test_top_queue_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "latest_kpi")


def test_entry_and_registry(spark):
    assert entry(spark).columns == ["period", "department", "received", "resolved", "on_time", "overdue", "on_time_rate"]
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) == set(ORACLE)
