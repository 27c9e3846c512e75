import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servicelens.operators import mapping
from servicelens.sources import exports as csv
from servicelens.sources import inventory as inv
from servicelens.sources import store
from servicelens.tables import values_table

from . import fixtures as fx

FILES = {
    "quoted": ('﻿id,name,status\r\n1,"Road, west",open\r\n2,"A ""quoted"" name",closed\r\n', "ok"),
    "multiline": ('id,note\n1,"line one\nline two"', "ok"),
    "nothing": ("", "empty"),
    "blank_only": ("\n \n\n", "empty"),
    "header_only": ("id,status", "empty"),
    "repeated": ("id,id\n1,2", "headers"),
    "repeated_case": ("id, ID\n1,2", "headers"),
    "blank_header": ("id,\n1,2", "headers"),
    "unclosed": ('id,name\n1,"unclosed', "format"),
    "unclosed_early": ('id,name\n"1,a\n2,b\n3,c\n', "format"),
    "extra_cell": ("id,status\n1,open,extra", "format"),
    "missing_cell": ("id,status\n1\n2,open", "format"),
    "empty_wide": ("id,status\n,,,,\n1,open", "format"),
    "empty_cells": ("id,status\n,\n1,open", "ok"),
    "quote_in_bare": ('id,s\na"b,open', "format"),
    "text_after_quote": ('id,s\n"x"y,2', "format"),
    "space_before_quote": ('id,s\n "x",2', "format"),
    "spaces_line": ("id,status\n   \n1,open\n \n\n2,x", "ok"),
    "quoted_empty_line": ('id\n""\n   \n5', "ok"),
    "cr": ("id,s\r1,a\r2,b", "ok"),
    "mixed_endings": ('id,s\n1,a\r2,"b\r\nc"\r\n3,c', "ok"),
    "mixed_crlf": ("id,s\r\n1,a\n2,b\r3,c\r\n", "ok"),
    "leading_blank": ("\n\n  \nid,s\n1,a\n", "ok"),
    "quoted_header": ('﻿"id","a ""b"""\n1,2', "ok"),
    "columns_50": (",".join(f"h{i}" for i in range(50)) + "\n" + ",".join("x" * 50), "ok"),
    "columns_51": (",".join(f"h{i}" for i in range(51)) + "\n" + ",".join("x" * 51), "size"),
    "columns_60": (",".join(f"h{i}" for i in range(60)) + "\n" + ",".join("x" * 60), "size"),
    "columns_75": (",".join(f"h{i}" for i in range(75)) + "\n" + ",".join("x" * 75), "size"),
    "rows_10000": ("id,status\n" + "\n".join(f"{i},open" for i in range(10_000)), "ok"),
    "rows_10001": ("id,status\n" + "\n".join(f"{i},open" for i in range(10_001)), "size"),
    "bytes": ("id,note\n1," + "x" * 1_000_000, "size"),
    "many_escapes": ('id,note\n1,"' + '""' * 100_000 + '"', "ok"),
    "many_quoted": ("id,note\r\n" + '1,"a\nb"\r\n' * 9_000, "ok"),
    "wide_record": (",".join(f"h{i}" for i in range(40)) + "\n" + ",".join(['"' + "x\r\n" * 2_000 + '"'] * 40), "ok"),
    "sample": (fx.SAMPLE_CSV, "ok"),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("exports")
    for name, (content, _) in FILES.items():
        (path / f"{name}.csv").write_text(content, encoding="utf-8", newline="")
    (path / "UPPER.CSV").write_text("id,s\n1,2", encoding="utf-8")
    (path / "workbook.xlsx").write_text("id,s\n1,2", encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def landed(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("landed") / "records")
    records = csv.land_records(spark, folder, out, csv.PREVIEW_LIMITS)
    return records, csv.file_verdict(spark, folder, csv.PREVIEW_LIMITS, records=records, locale="en")


def test_verdicts(landed):
    got = {r.name: r.verdict for r in landed[1].collect()}
    expected = {f"{name}.csv": verdict for name, (_, verdict) in FILES.items()}
    assert got == {**expected, "UPPER.CSV": "ok", "workbook.xlsx": "type"}


def test_verdict_without_landing_agrees(spark, folder, landed):
    direct = {(r.name, r.verdict, r.rows) for r in csv.file_verdict(spark, folder, csv.PREVIEW_LIMITS).collect()}
    assert direct == {(r.name, r.verdict, r.rows) for r in landed[1].collect()}


def test_messages_and_row_counts(landed):
    rows = {r.name: r for r in landed[1].collect()}
    assert rows["workbook.xlsx"].message.startswith("Choose a .csv file")
    assert rows["quoted.csv"].message is None and rows["quoted.csv"].rows == 2
    assert rows["rows_10001.csv"].rows == 10_001
    assert rows["rows_10001.csv"].message == "Choose a CSV under 1 MB, with up to 10,000 rows and 50 columns."
    assert rows["spaces_line.csv"].rows == 2
    assert rows["quoted_header.csv"].header == ["id", 'a "b"']


def test_single_checks(landed, spark, folder):
    records, _ = landed
    stats = csv.file_stats(records)
    files = csv.listing(spark, folder)

    def names(df):
        return {r.file.rsplit("/", 1)[1][:-4] for r in df.collect()}

    assert names(csv.header_check(stats, files)) == {"repeated", "repeated_case", "blank_header"}
    assert {"extra_cell", "missing_cell", "empty_wide"} <= names(csv.ragged_files(stats, files))
    assert {"unclosed", "unclosed_early", "quote_in_bare", "text_after_quote", "space_before_quote"} == names(
        csv.quote_errors(stats, files)
    )
    assert {"nothing", "blank_only", "header_only"} <= names(csv.empty_files(stats, files))
    assert names(csv.file_limits(stats, files, csv.PREVIEW_LIMITS)) == {
        "columns_51", "columns_60", "columns_75", "rows_10001", "bytes",
    }


def test_cells(landed):
    rows = csv.data_records(*landed).orderBy("file", "pos").collect()
    cells = {}
    for r in rows:
        cells.setdefault(r.file.rsplit("/", 1)[1][:-4], []).append(r.cells)
    assert cells["quoted"] == [["1", "Road, west", "open"], ["2", 'A "quoted" name', "closed"]]
    assert cells["multiline"] == [["1", "line one\nline two"]]
    assert cells["empty_cells"] == [["", ""], ["1", "open"]]
    assert cells["quoted_empty_line"] == [[""], ["5"]]
    assert cells["cr"] == [["1", "a"], ["2", "b"]]
    assert cells["mixed_endings"] == [["1", "a"], ["2", "b\r\nc"], ["3", "c"]]
    assert cells["mixed_crlf"] == [["1", "a"], ["2", "b"], ["3", "c"]]
    assert cells["leading_blank"] == [["1", "a"]]
    assert cells["many_escapes"] == [["1", '"' * 100_000]]
    assert "repeated" not in cells and "unclosed" not in cells


def test_mapping_proposal_and_preview(landed):
    records, verdicts = landed
    headers = csv.header_cells(verdicts)
    proposed = mapping.propose_mapping(headers)
    by_file = {}
    for r in proposed.collect():
        by_file.setdefault(r.file.rsplit("/", 1)[1][:-4], {})[r.field] = r.column_index
    assert by_file["sample"] == {"id": 0, "department": 1, "status": 2}
    assert by_file["multiline"] == {"id": 0, "department": -1, "status": -1}
    valid = mapping.validate_mapping(proposed, headers).where("valid")
    assert {r.file.rsplit("/", 1)[1] for r in valid.collect()} == {"sample.csv"}
    first = mapping.apply_file_mapping(
        csv.preview(records, verdicts, 3), proposed.join(valid, "file", "left_semi"), mapping.REQUIRED
    ).orderBy("row_no").collect()
    assert [(r.row_no, r.id, r.department, r.status) for r in first] == [
        (1, "EP-001", "public", "open"), (2, "EP-002", "public", "closed"), (3, "EP-003", "urban", "open"),
    ]


@pytest.mark.parametrize(
    "indexes, valid",
    [((0, 1, 2), True), ((0, 0, 2), False), ((0, 1, -1), False), ((0, 1, 5), False)],
)
def test_mapping_validation(spark, indexes, valid):
    headers = values_table(spark, [("f", i, h) for i, h in enumerate("abc")], "file string, position int, header string")
    given = values_table(
        spark, [("f", name, i) for name, i in zip(mapping.REQUIRED, indexes)], "file string, field string, column_index int"
    )
    assert mapping.validate_mapping(given, headers).first().valid is valid


def test_headers_in_either_language(spark):
    headers = values_table(
        spark,
        [("f", 0, "Statusi"), ("f", 1, "DREJTORIA"), ("f", 2, "RequestID"), ("f", 3, "id")],
        "file string, position int, header string",
    )
    got = {r.field: r.column_index for r in mapping.propose_mapping(headers).collect()}
    assert got == {"id": 2, "department": 1, "status": 0}


def test_reading_in_blocks_agrees(spark, folder, landed):
    """Blocks of a few bytes: records and quoted cells run over many of them."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        chosen = csv.FileLimits(max_bytes=3_000)
        records = csv.parse_records(csv.raw_records(spark, folder, 3_000, split_above=0)).cache()
        got = {r.name: r.verdict for r in csv.file_verdict(spark, folder, chosen, records=records).collect()}
        rows = {}
        for r in records.orderBy("file", "pos").collect():
            rows.setdefault(r.file.rsplit("/", 1)[1], []).append(r.cells)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, (content, verdict) in FILES.items():
        if len(content) <= 3_000 and not name.startswith("columns_"):
            assert got[f"{name}.csv"] == verdict, name
    assert rows["mixed_endings.csv"] == [["id", "s"], ["1", "a"], ["2", "b\r\nc"], ["3", "c"]]
    assert rows["multiline.csv"] == [["id", "note"], ["1", "line one\nline two"]]
    assert rows["quoted_header.csv"] == [["id", 'a "b"'], ["1", "2"]]


@pytest.mark.parametrize("block, largest", [("40", 3_000), ("100000", None)])
def test_results_do_not_depend_on_how_files_are_read(spark, folder, block, largest):
    """Every column of every verdict and all rows, for sound and broken files, read whole and in blocks."""

    def result(split_above):
        records = csv.parse_records(csv.raw_records(spark, folder, largest, split_above)).cache()
        verdicts = csv.file_verdict(spark, folder, csv.FileLimits(max_bytes=largest), records=records)
        rows = csv.data_records(records, verdicts).orderBy("file", "pos").select("file", "cells").collect()
        found = verdicts.drop("header_pos").orderBy("file").collect()
        bad = records.where("not well_quoted").select("file", "raw").orderBy("file").collect()
        return found, rows, bad

    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert result(0) == result(csv.SPLIT_ABOVE)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_no_limits_by_default(spark, folder):
    got = {r.name: r.verdict for r in csv.file_verdict(spark, folder).collect()}
    assert got["rows_10001.csv"] == got["columns_60.csv"] == got["bytes.csv"] == "ok"


def test_names_with_spaces_and_signs(spark, tmp_path):
    for name in ("të dhëna 1.csv", "a%20b+c.csv", "zero +.csv"):
        (tmp_path / name).write_text("" if name.startswith("zero") else "id,s\n1,2", encoding="utf-8")
    verdicts = csv.file_verdict(spark, str(tmp_path))
    assert {r.name for r in verdicts.collect()} == {"të dhëna 1.csv", "a%20b+c.csv", "zero +.csv"}
    files = inv.file_inventory(verdicts, F.lit("public")).collect()
    assert {r.filename for r in files} == {"të dhëna 1.csv", "a%20b+c.csv"} and all(r.period for r in files)


def test_typed_read(spark, folder):
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("request_id", "department", "status", "created_at")])
    rows = csv.read_export(spark, f"{folder}/sample.csv", schema)
    typed, errors = mapping.coerce(rows, {"created_at": "date", "department": "bigint"})
    assert [str(r.created_at) for r in typed.orderBy("request_id").limit(1).collect()] == ["2026-09-01"]
    assert {r.column: r.errors for r in errors.collect()} == {"created_at": 0, "department": 5}


def test_canonical_write_replaces_one_source(spark, tmp_path):
    out = str(tmp_path / "canonical")

    def rows(source, n):
        return spark.range(n).select("id", F.lit(source).alias("source_id"), F.current_date().alias("created_at"))

    store.write_canonical(rows("a", 5).unionByName(rows("b", 3)), out)
    store.write_canonical(rows("a", 2), out)
    counts = {r.source_id: r["count"] for r in spark.read.parquet(out).groupBy("source_id").count().collect()}
    assert counts == {"a": 2, "b": 3}


def test_metric_exports_and_views(spark, tmp_path):
    table = fx.metrics(spark)
    for fmt in ("parquet", "json", "csv"):
        store.export_metrics(table, str(tmp_path / fmt), fmt)
    assert spark.read.json(str(tmp_path / "json")).count() == 8
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 8
    with pytest.raises(ValueError):
        store.export_metrics(table, str(tmp_path / "x"), "xlsx")
    spark.range(1500).createOrReplaceTempView("kpi_view")
    assert store.read_view(spark, "kpi_view", ["kpi_view"], limit=None).count() == 1500
    assert store.read_view(spark, "kpi_view", ["kpi_view"], limit=1500).count() == 1500
    for limit in (1000, 7):
        with pytest.raises(ValueError):
            store.read_view(spark, "kpi_view", ["kpi_view"], limit=limit)
    first = store.read_view(spark, "kpi_view", ["kpi_view"], ["id"], 3, order_by=["id"], cut=True)
    assert [r.id for r in first.collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        store.read_view(spark, "kpi_view", ["kpi_view"], ["id"], 3, cut=True)
    with pytest.raises(ValueError):
        store.read_view(spark, "secret", ["kpi_view"])


def test_cells_of_records_that_are_too_wide_are_counted_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "wide.csv").write_text('a,b,c\n1,2,3\n1,"x,y",3,4\n')
    (tmp_path / "in" / "good.csv").write_text("a,b\n1,2\n")
    records = csv.land_records(spark, str(tmp_path / "in"), str(tmp_path / "out"), csv.FileLimits(max_columns=2))
    got = sorted((r["n_cells"], r["cells"]) for r in records.where("file like '%wide%'").collect() if r["pos"]["part"])
    assert got == [(3, None), (4, None)]
    verdicts = csv.file_verdict(spark, str(tmp_path / "in"), csv.FileLimits(max_columns=2), records=records)
    assert {r["name"]: (r["verdict"], r["rows"]) for r in verdicts.collect()} == {"wide.csv": ("format", 2), "good.csv": ("ok", 1)}
    counts = csv.file_stats(records)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in counts


def test_texts_and_records_are_cut_once(spark, tmp_path):
    """A landing cuts each text into records, checks each record and cuts it into cells once."""
    (tmp_path / "a.csv").write_text('id,note\n1,"a, ""b"""\n2,plain\n')
    found = csv.parse_records(csv.raw_records(spark, str(tmp_path)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    ways = 1 + plan.count("Union")  # small files and large ones
    assert 0 < plan.count(csv._RECORD) <= ways and 0 < plan.count(csv._CELL) <= ways
    rows = [(r["cells"], r["n_cells"], r["well_quoted"], r["raw"]) for r in found.orderBy("pos").collect()]
    assert rows == [(["id", "note"], 2, True, None), (["1", 'a, "b"'], 2, True, None), (["2", "plain"], 2, True, None)]
