import datetime as dt

import pytest
from pyspark.sql import functions as F

from servicelens.operators import mapping, quality
from servicelens.tables import values_table


@pytest.fixture(scope="module")
def people(spark):
    return values_table(
        spark,
        [
            (1, "Arta Hoxha", "arta@example.al", "+355 69 123 4567", "K12345678L", "open", "2026-09-01"),
            (2, "Ben Leka", "ben@example.al", None, "nothing", "closed", "2026-09-31"),
            (3, None, "none", "call 0691234567", "", "open", ""),
        ],
        "id bigint, full_name string, contact string, reach string, card string, status string, created_at string",
    )


def test_personal_columns(people):
    flagged = {(r.column, r.kind) for r in quality.pii_profile(people, 0.3).where("flagged").collect()}
    assert flagged == {
        ("full_name", "name"), ("contact", "email"), ("reach", "phone"), ("card", "id_number"),
    }
    assert quality.drop_pii(people, quality.pii_profile(people, 0.3)).columns == ["id", "status", "created_at"]


def test_profile(people):
    rows = {r.column: r for r in quality.profile(people, exact_distinct=True).collect()}
    assert rows["reach"].nulls == 1 and rows["reach"].null_pct == pytest.approx(100 / 3)
    assert rows["id"].type == "bigint" and rows["id"].reads_as_long == 1.0
    assert rows["created_at"].reads_as_date == pytest.approx(1 / 3)
    assert rows["status"].distinct_values == 2 and set(rows["status"].samples) <= {"open", "closed"}
    assert rows["status"].samples
    sketched = {r.column: r for r in quality.profile(people).collect()}
    assert sketched["status"].distinct_values == 2


def test_coercion_counts_what_does_not_fit(people):
    typed, errors = mapping.coerce(people, {"created_at": "date", "status": "bigint"})
    assert {r.column: r.errors for r in errors.collect()} == {"created_at": 1, "status": 3}
    assert [r.created_at for r in typed.orderBy("id").collect()] == [dt.date(2026, 9, 1), None, None]


def test_required_fields(people):
    complete, incomplete, counts = mapping.require_fields(people, ["id", "full_name", "reach"])
    assert complete.count() == 1
    assert {r.id: r.missing for r in incomplete.collect()} == {2: ["reach"], 3: ["full_name"]}
    assert {r.field: r.missing for r in counts.collect()} == {"id": 0, "full_name": 1, "reach": 1}


def test_named_mapping_and_stored_mapping(spark, people):
    assert mapping.apply_mapping(people, {"request": "id", "state": "status"}).columns == ["request", "state"]
    stored = values_table(spark, [("a", '{"id": "request_id"}'), ("b", "not json")], "id string, mapping_json string")
    got = {r.id: r.mapping for r in mapping.decode_mapping(stored).collect()}
    assert got == {"a": {"id": "request_id"}, "b": None}


def test_golden_accuracy(spark):
    schema = "question_id string, value double"
    expected = values_table(spark, [("a", 1.0), ("b", None), ("c", 3.0), ("d", None)], schema)
    actual = values_table(spark, [("a", 1.0), ("b", None), ("c", 4.0), ("e", 5.0)], schema)
    compared, score = quality.golden_accuracy(expected, actual)
    assert {r.question_id: r.ok for r in compared.collect()} == {"a": True, "b": True, "c": False, "d": False, "e": False}
    assert tuple(score.first()) == (5, 2, pytest.approx(0.4))


def test_values_table_text(spark):
    odd = "it's \\ \"x\"\nnew ë"
    row = values_table(spark, [(odd, 0.1, None)], "t string, d double, n int").first()
    assert (row.t, row.d, row.n) == (odd, 0.1, None)
    assert values_table(spark, [(1,)], "a int").select(F.sum("a")).first()[0] == 1


def test_rows_with_faults_are_put_aside(spark):
    rows = values_table(
        spark,
        [("1", " a ", "2026-09-01"), ("x", "b", "2026-09-02"), ("3", " ", "soon"), (None, "d", None), ("5 ", "e", "\t")],
        "id string, department string, created_at string",
    )
    typed, rejected = mapping.checked_rows(rows, {"id": "bigint", "created_at": "date"}, ["id", "department"])
    assert sorted(r.id for r in typed.collect()) == [1, 5]
    assert dict(typed.dtypes) == {"id": "bigint", "department": "string", "created_at": "date"}
    counts = {(r.field, r.problem): r.rows for r in mapping.fault_counts(rejected).collect()}
    assert counts == {
        ("id", "type"): 1, ("id", "missing"): 1, ("department", "missing"): 1, ("created_at", "type"): 1,
    }
    assert typed.count() + rejected.count() == rows.count()


def test_saved_mappings(spark):
    headers = values_table(
        spark,
        [("f1", "a", i, h) for i, h in enumerate(["No", "Place", "status"])]
        + [("f2", "b", i, h) for i, h in enumerate(["id", "department", "status"])]
        + [("f3", "c", 0, "id")],
        "file string, source string, position int, header string",
    )
    saved = values_table(
        spark,
        [("a", '{"id":"No","department":"Place","status":"status"}'), ("b", '{"id":"Nr","status":"status"}')],
        "source string, mapping_json string",
    )
    got = mapping.saved_mapping(saved, headers, mapping.propose_mapping(headers)).collect()
    by = {f: {(r.field, r.column_index, r.origin) for r in got if r.file == f} for f in ("f1", "f2", "f3")}
    assert by["f1"] == {("id", 0, "saved"), ("department", 1, "saved"), ("status", 2, "saved")}
    assert by["f2"] == {("id", 0, "proposed"), ("department", 1, "proposed"), ("status", 2, "proposed")}
    assert {o for _, _, o in by["f3"]} == {"proposed"}
    kept = mapping.mapping_json(mapping.propose_mapping(headers), headers).collect()
    assert {r.file: r.mapping_json for r in kept}["f3"] == '{"id":"id"}'


def test_headers_of_harmless_columns_are_not_personal(spark):
    columns = ["cancelled_at", "parcel_id", "excel_rows", "location_name", "name_sq", "phone", "tel_nr", "mobile", "contact_name", "e_mail"]
    rows = values_table(spark, [tuple("x" for _ in columns)], ", ".join(f"{c} string" for c in columns))
    flagged = {r["column"] for r in quality.pii_profile(rows).where("flagged").collect()}
    assert flagged == {"phone", "tel_nr", "mobile", "contact_name", "e_mail"}
