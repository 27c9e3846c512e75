"""The reports over deliveries and decisions: each has its SQL, and plans without crossed rows or Python."""

import os

import pytest

from servicelens.plans import deliveries, insights, oracle, queries

TABLES = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables are not here")


def plan(spark, name):
    return insights.QUERIES[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()


def test_every_report_has_its_sql():
    assert set(deliveries.QUERIES) == set(deliveries.ORACLE)
    assert set(insights.QUERIES) == set(insights.ORACLE)
    names = [*queries.QUERIES, *deliveries.QUERIES, *insights.QUERIES]
    assert len(names) == len(set(names))
    assert set(oracle.ORACLE).isdisjoint({*deliveries.ORACLE, *insights.ORACLE})


@pytest.mark.parametrize("name", ["trend_decisions", "kpi_trends", "personal_columns", "golden_answers", "guarded_statements"])
def test_no_crossed_rows_and_no_python(spark, name):
    text = plan(spark, name)
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow", "Scan ExistingRDD"):
        assert unwanted not in text, unwanted


def test_only_the_last_points_of_a_series_meet(spark):
    assert "WindowGroupLimit" in plan(spark, "trend_decisions")


def test_personal_columns_are_one_pass(spark):
    text = plan(spark, "personal_columns")
    assert text.count("FileScan parquet") == 1 and "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_exports_are_written_once_for_the_same_tables(spark):
    from servicelens.plans import exports

    folder = exports.kept_exports(spark, TABLES)
    assert exports.kept_exports(spark, TABLES) == folder
    key = next(k for k, v in exports._kept.items() if v == folder)
    exports._kept[key] = folder + "-gone"  # as if it had been cleared away
    assert exports.kept_exports(spark, TABLES) not in (folder, folder + "-gone")


def test_statements_do_not_run_before_they_are_judged(spark):
    spark.sql("select 1 as n").createOrReplaceTempView("kept_view")
    insights.statements.check_statement(spark, "drop view kept_view", ["kept_view"])
    assert spark.table("kept_view").count() == 1


def test_exports_of_some_kinds_are_those_of_all(spark):
    """Only what is asked for is written, and it is what it would be beside the others."""
    from servicelens.plans import exports

    def files(folder, kinds):
        found = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text([f"{folder}/kind={k}" for k in kinds], wholetext=True)
        rows = found.selectExpr("regexp_extract(_metadata.file_path, '/(kind=.*)/', 1) AS place", "value").collect()
        return sorted(map(tuple, rows))

    every = exports.write_exports(spark, TABLES)
    kinds = ["good", "faulty", "blank"]
    some = exports.write_exports(spark, TABLES, kinds)
    assert sorted(n for n in os.listdir(some) if n.startswith("kind=")) == sorted(f"kind={k}" for k in kinds)
    assert files(some, kinds) == files(every, kinds)
    places = [place for place, _ in files(every, ["text", "empty", *kinds])]
    assert len(places) == len(set(places))


@pytest.mark.parametrize(
    ("name", "kinds"),
    [("ingest_errors", ("faulty",)), ("released_rows", ("faulty",)), ("ingest_canonical", ("good",)), ("reused_mapping", ("good", "faulty")), ("mapping_proposal", ()), ("ingest_outcomes", ())],
)
def test_only_kinds_that_a_report_asks_about_are_written(spark, monkeypatch, name, kinds):
    from servicelens.plans import exports

    class Asked(Exception):
        pass

    def asked(spark, path, kinds=()):
        raise Asked(tuple(kinds))

    monkeypatch.setattr(exports, "kept_exports", asked)
    with pytest.raises(Asked) as found:
        {**queries.QUERIES, **deliveries.QUERIES}[name](spark, TABLES)
    assert found.value.args[0] == kinds


@pytest.mark.parametrize("name", ["ingest_verdict", "mapping_proposal", "reused_mapping", "source_lineage"])
def test_reports_on_files_write_no_records(spark, monkeypatch, name):
    monkeypatch.setattr(queries.csv, "land_records", lambda *_: pytest.fail("records are written"))
    assert queries.QUERIES[name](spark, TABLES).count() > 0
