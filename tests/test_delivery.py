"""File discovery by tasks, the manifest, and files whose lines end with a carriage return alone."""

import random

import pytest
from pyspark.sql import functions as F

from servicelens.sources import delivery, exports


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    for name, text in {
        "a.csv": "id,s\n1,open\n",
        "b c%é+&.csv": "id,s\r\n1,open\r\n",
        "kind=x/d.csv": "id,s\r1,open\r2,closed\r",
        "kind=x/year=1/e.csv": "",
        "_hidden.csv": "id,s\n",
        ".hidden": "x",
        "kind=y/_SUCCESS": "",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())
    return str(root)


def test_discovery_finds_what_scans_find_and_empty_files(spark, folder):
    found = {r["name"]: r for r in delivery.discover(spark, folder, head_above=0).collect()}
    assert set(found) == {"a.csv", "b c%é+&.csv", "d.csv", "e.csv"}
    assert {n: r["line_end"] for n, r in found.items()} == {"a.csv": "lf", "b c%é+&.csv": "crlf", "d.csv": "cr", "e.csv": None}
    assert found["e.csv"]["bytes"] == 0 and found["e.csv"]["modified"] is not None
    listed = {r["file"]: r for r in exports.listing(spark, folder).collect()}
    assert {f["file"] for f in found.values()} == set(listed)
    for r in found.values():
        if r["bytes"]:
            assert (r["bytes"], r["modified"]) == (listed[r["file"]]["bytes"], listed[r["file"]]["modified"])
    assert {r["name"] for r in delivery.discover(spark, "file://" + folder).collect()} == set(found)


def test_manifest_knows_what_is_new(spark, folder, tmp_path):
    kept = str(tmp_path / "manifest")
    assert delivery.read_manifest(spark, kept).isEmpty()

    def take_in(number):
        found = delivery.discover(spark, folder)
        new = delivery.new_files(found, delivery.read_manifest(spark, kept))
        return {r["name"] for r in delivery.record_delivery(spark, new, kept, number).collect()}

    assert take_in(1) == {"a.csv", "b c%é+&.csv", "d.csv", "e.csv"}
    (tmp_path / "in" / "a.csv").write_text("id,s\n1,open\n2,open\n")
    (tmp_path / "in" / "f.csv").write_text("id,s\n1,open\n")
    assert take_in(2) == {"a.csv", "f.csv"}
    assert take_in(3) == set()
    files = delivery.discover(spark, folder)
    verdicts = exports.file_verdict(spark, folder, files=files)
    summary = {r["delivery"]: r for r in delivery.delivery_summary(delivery.read_manifest(spark, kept), verdicts).collect()}
    assert (summary[1]["files"], summary[1]["empty"], summary[1]["accepted"]) == (4, 1, 3)
    assert (summary[2]["files"], summary[2]["accepted"], summary[2]["rows"]) == (2, 2, 3)


def test_no_import_plan_lists_files_on_the_driver(spark, folder, monkeypatch):
    files = delivery.discover(spark, folder)
    monkeypatch.setattr(type(files), "inputFiles", lambda self: pytest.fail("names pass the driver"))
    verdicts = exports.file_verdict(spark, folder, files=files)
    assert "ExistingRDD" not in verdicts._jdf.queryExecution().executedPlan().toString()
    assert {r["name"]: r["verdict"] for r in verdicts.collect()} == {
        "a.csv": "ok", "b c%é+&.csv": "ok", "d.csv": "ok", "e.csv": "empty"
    }


@pytest.mark.parametrize(
    ("head", "end"),
    [
        (b"a,b\nc", "lf"), (b"a,b\r\nc", "crlf"), (b"a,b\rc", "cr"), (b'"a\nb","c\rd"\r1', "cr"), (b'"a""\r\n"\n', "lf"),
        (b"a,b", None), (b"", None), (b'"open\n', None), (b"a\r", None), (b"\n", "lf"),
    ],
)
def test_first_line_end(head, end):
    assert delivery.first_line_end(head) == end


def write(path, records, end):
    path.write_bytes(("id,note" + end + end.join(records) + end).encode())


def test_blocks_of_files_that_end_lines_with_returns(spark, tmp_path):
    rng = random.Random(1)
    cells = ["x", '"a\rb"', '"c\nd"', '"e""\r\n""f"', " ", '"\r\r"', "é"]
    for n, fault in enumerate([None, None, '1,"open', '1,a"b', "1,2,3", "\n\n", "1,a\n2,b"]):
        records = [f"{i},{rng.choice(cells)}" for i in range(300)]
        if fault:
            records.insert(150, fault)
        (tmp_path / "in").mkdir(exist_ok=True)
        write(tmp_path / "in" / f"f{n}.csv", records, "\r")
        write(tmp_path / "in" / f"g{n}.csv", records, "\n")
    folder = str(tmp_path / "in")
    found = delivery.discover(spark, folder, head_above=0)
    returns = delivery.return_files(found)
    assert sorted(r.rsplit("/", 1)[1] for r in returns) == [f"f{n}.csv" for n in range(7)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        blocks = exports.raw_records(spark, folder, split_above=0, returns=returns)
        assert blocks.select("pos.block").distinct().count() > 3
        landed = exports.land_records(spark, folder, str(tmp_path / "blocks"), split_above=0, returns=returns)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = exports.land_records(spark, folder, str(tmp_path / "whole"))

    def verdicts(records):
        out = exports.file_verdict(spark, folder, records=records, files=found)
        return sorted((r["name"], r["verdict"], r["rows"], r["header"]) for r in out.collect())

    def cells_of(records):
        out = records.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("pos", "cells"))).alias("r"))
        return {r["file"]: [x["cells"] for x in r["r"]] for r in out.collect()}

    assert verdicts(landed) == verdicts(whole)
    assert cells_of(landed) == cells_of(whole)
