"""The way from files to requests: nothing is lost, nothing counts twice."""

import pytest
from pyspark.sql import functions as F

from servicelens.operators import mapping
from servicelens.sources import delivery, exports, ingest

TYPES = {"id": "bigint", "created_at": "date"}
PATTERNS = (*mapping.PATTERNS, ("created_at", "^created_at$"))

FILES = {
    "a-1.csv": "id,department,status,created_at\n1,x,open,2024-01-01\n2,,open,2024-01-02\nz,y,closed,soon\n",
    "a-2.csv": "id,place,status\n4,x,open\n",
    "b-1.csv": 'id,department,status\n5,"x, y",open\n6,y,closed\n',
    "b-2.csv": "id,id,status\n7,x,open\n",
    "b-3.txt": "id,department,status\n8,x,open\n",
    "c-1.csv": "",
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in FILES.items():
        (tmp_path / "in" / name).write_text(text)
    return tmp_path


def take_in(spark, folder, number, sources=None):
    files = delivery.discover(spark, str(folder / "in"))
    records = exports.land_records(spark, str(folder / "in"), str(folder / f"landed-{number}"))
    verdicts = exports.file_verdict(spark, str(folder / "in"), records=records, files=files)
    source = F.regexp_extract("file", "/([a-z]+)-[0-9]+[.][a-z]+$", 1)
    ingest.ingest(spark, records, verdicts, source, str(folder / "kept"), number, TYPES, PATTERNS, sources=sources)
    return sum(r["rows"] for r in verdicts.where("verdict = 'ok'").collect())


def shown(spark, folder):
    rows = ingest.ingested(spark, str(folder / "kept")).withColumn("name", F.substring_index("file", "/", -1))
    faults = F.transform("faults", lambda f: F.concat_ws(" ", f["field"], f["problem"]))
    found = rows.select("source_id", "name", "outcome", "id", "department", faults, "delivery").collect()
    return sorted(map(tuple, found), key=repr)


EXPECTED = [
    ("a", "a-1.csv", "canonical", 1, "x", [], 1),
    ("a", "a-1.csv", "faulty", 2, "", ["department missing"], 1),
    ("a", "a-1.csv", "faulty", None, "y", ["id type", "created_at type"], 1),
    ("a", "a-2.csv", "faulty", 4, None, ["department unmapped"], 1),
    ("b", "b-1.csv", "canonical", 5, "x, y", [], 1),
    ("b", "b-1.csv", "canonical", 6, "y", [], 1),
    ("b", "b-2.csv", "refused", None, None, ["headers"], 1),
    ("b", "b-3.txt", "refused", None, None, ["type"], 1),
    ("c", "c-1.csv", "refused", None, None, ["empty"], 1),
]


def test_every_row_is_kept_once(spark, folder):
    accepted = take_in(spark, folder, 1)
    assert shown(spark, folder) == sorted(EXPECTED, key=repr)
    kept = str(folder / "kept")
    faulty = ingest.quarantine(spark, kept).where("outcome = 'faulty'")
    assert ingest.canonical_rows(spark, kept).count() + faulty.count() == accepted == 6
    texts = {r["given"]["id"]: r["given"] for r in faulty.collect()}
    assert texts["z"] == {"id": "z", "department": "y", "status": "closed", "created_at": "soon"}
    assert ingest.canonical_rows(spark, kept).dtypes[0][0] == "file"


def test_a_source_delivered_again_is_replaced(spark, folder):
    take_in(spark, folder, 1)
    # the faults of a are gone, and with them its quarantine
    (folder / "in" / "a-1.csv").write_text("id,department,status\n1,x,open\n")
    (folder / "in" / "a-2.csv").unlink()
    take_in(spark, folder, 2, sources=["a"])
    rest = [r for r in EXPECTED if r[0] != "a"]
    assert shown(spark, folder) == sorted([*rest, ("a", "a-1.csv", "canonical", 1, "x", [], 2)], key=repr)
    take_in(spark, folder, 3)
    take_in(spark, folder, 3)  # given again
    assert {r[-1] for r in shown(spark, folder)} == {3} and len(shown(spark, folder)) == len(rest) + 1
    log = {(r["source_id"], r["delivery"]): r["rows"] for r in ingest.delivery_log(spark, str(folder / "kept")).collect()}
    assert log == {("a", 1): 4, ("b", 1): 4, ("c", 1): 1, ("a", 2): 1, ("a", 3): 1, ("b", 3): 4, ("c", 3): 1}


def test_corrected_rows_leave_quarantine(spark, folder):
    take_in(spark, folder, 1)
    kept = str(folder / "kept")
    faulty = ingest.quarantine(spark, kept).where("outcome = 'faulty'")
    mended = faulty.select(
        "source_id", "file", "pos",
        F.when(F.col("given")["id"] == "2", F.create_map(F.lit("department"), F.lit("new")))
        .otherwise(F.create_map(F.lit("created_at"), F.lit("2024-02-02"))).alias("given"),
    ).where(F.col("file").endswith("a-1.csv"))
    mended = spark.createDataFrame(mended.collect(), mended.schema)
    ingest.release(spark, kept, mended, TYPES, [f for f, _ in PATTERNS], mapping.REQUIRED, 2)
    found = {r[3:6][0]: r for r in shown(spark, folder) if r[1] == "a-1.csv"}
    assert found[2] == ("a", "a-1.csv", "canonical", 2, "new", [], 2)
    assert found[None] == ("a", "a-1.csv", "faulty", None, "y", ["id type"], 2)
    assert len(shown(spark, folder)) == len(EXPECTED)
