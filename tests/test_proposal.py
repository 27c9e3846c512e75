"""Assignment of columns to fields, and dimensions with history."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from servicelens.operators import dimensions, proposal
from servicelens.tables import values_table


def slow_assignment(scores, fields, least):
    """The largest sum over all ways to give fields a column or none."""
    columns = sorted({p for p, _ in scores})
    best = 0.0
    for chosen in itertools.product([None, *columns], repeat=len(fields)):
        used = [c for c in chosen if c is not None]
        if len(set(used)) < len(used):
            continue
        parts = [scores.get((c, f), 0.0) for c, f in zip(chosen, fields, strict=True) if c is not None]
        if all(s >= least for s in parts):
            best = max(best, sum(parts))
    return best


@pytest.mark.parametrize("seed", range(60))
def test_assignment_is_the_best(seed):
    rng = random.Random(seed)
    fields = ["a", "b", "c", "d"][: rng.randrange(1, 5)]
    scores = {(p, f): round(rng.choice([0.2, 0.5, 0.6, 0.9, rng.random()]), 3) for p in range(rng.randrange(1, 6)) for f in fields}
    found = proposal.best_assignment(scores, fields, 0.4)
    assert len(set(found.values())) == len(found) and all(scores[p, f] >= 0.4 for f, p in found.items())
    assert sum(scores[p, f] for f, p in found.items()) == pytest.approx(slow_assignment(scores, fields, 0.4))


def test_a_greedy_choice_would_lose():
    scores = {(0, "a"): 0.9, (0, "b"): 0.8, (1, "a"): 0.85, (1, "b"): 0.1}
    assert proposal.best_assignment(scores, ["a", "b"], 0.4) == {"a": 1, "b": 0}
    assert proposal.best_assignment({}, ["a"], 0.4) == {}


def mapped(spark, headers, rows):
    head = values_table(spark, [("f", i, h) for i, h in enumerate(headers)], "file string, position int, header string")
    records = spark.createDataFrame([("f", list(map(str, r))) for r in rows], "file string, cells array<string>")
    chosen = proposal.assign_mapping(head, proposal.value_profile(records)).collect()
    return {r["field"]: r["column_index"] for r in chosen}


@pytest.mark.parametrize(
    ("headers", "expected"),
    [
        (["Nr. i kërkesës", "dept_name", "Gjendja", "Data e hapjes"], {"id": 0, "department": 1, "status": 2, "created_at": 3, "note": -1}),
        (["status", "RequestID", "Shënime", "created", "Drejtoria"], {"id": 1, "department": 4, "status": 0, "created_at": 3, "note": 2}),
        (["department_head", "department", "id", "state", "dt"], {"id": 2, "department": 1, "status": 3, "created_at": 4, "note": -1}),
        (["x", "y", "z"], {"id": -1, "department": -1, "status": -1, "created_at": -1, "note": -1}),
    ],
)
def test_headers_in_other_words(spark, headers, expected):
    values = {"id": lambda i: i, "department": lambda i: "ab"[i % 2], "status": lambda i: "open", "created_at": lambda i: "2024-01-02", "note": lambda i: f"n {i}"}
    of = {p: f for f, p in expected.items() if p >= 0}
    rows = [[values[of[p]](i) if p in of else "k" for p in range(len(headers))] for i in range(20)]
    assert mapped(spark, headers, rows) == expected


def test_values_decide_between_equal_names(spark):
    # two columns of the same word: the one with dates is the date
    assert mapped(spark, ["date", "date 2", "id"], [["n/a", "2024-01-01", 1], ["n/a", "2024-01-02", 2]])["created_at"] == 1
    # a file without rows is mapped by its headers
    assert mapped(spark, ["id", "status"], []) == {"id": 0, "department": -1, "status": 1, "created_at": -1, "note": -1}


NAMES = "id string, name_sq string, name_en string, valid_from date"
DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_rows_see_the_version_of_their_time(spark):
    rng = random.Random(1)
    changes = [("a", "A1", "E1", day(0)), ("a", "A2", None, day(50)), ("b", None, "B1", day(20)), ("c", "C", "C", day(0)), ("c", "C", "C", day(0))]
    history = dimensions.versions(values_table(spark, changes, NAMES))
    rows = [(i, rng.choice("abcd"), day(rng.randrange(-5, 100))) for i in range(300)] + [(900, None, day(1)), (901, "a", None)]
    frame = values_table(spark, rows, "n bigint, department_id string, at date")
    joined = dimensions.as_of(frame, history, "department_id", "at", "department")
    found = {r["n"]: r for r in dimensions.localized(joined, "department", "sq", "name").collect()}
    assert len(found) == len(rows)
    for n, key, at in rows:
        held = [c for c in sorted(set(changes), key=lambda c: c[3]) if c[0] == key and at is not None and c[3] <= at]
        last = held[-1] if held else (None, None, None)
        assert (found[n]["department_name_sq"], found[n]["department_name_en"]) == last[1:3]
        assert found[n]["name"] == (last[1] or last[2] or key)
    assert dimensions.overlaps(history).isEmpty()


def test_overlapping_versions_are_named(spark):
    rows = [("a", day(0), day(10)), ("a", day(9), None), ("a", day(40), None), ("b", day(0), day(5)), ("b", day(5), None)]
    frame = values_table(spark, rows, "id string, valid_from date, valid_to date")
    assert sorted(r["valid_from"] for r in dimensions.overlaps(frame).collect()) == [day(9), day(40)]


def test_all_four_dimensions(spark):
    requests = values_table(spark, [(1, "a", "x", "l", "s", DAY), (2, "q", "q", "q", "q", DAY)],
                            "id bigint, department_id string, category_id string, location_id string, source_id string, created_at date")
    names = dimensions.versions(values_table(spark, [("a", "A", "E", DAY), ("x", "X", "Y", DAY)], NAMES))
    places = values_table(spark, [("l", "north")], "id string, zone string")
    sources = values_table(spark, [("s", "s.csv")], "id string, filename string")
    full = {r["id"]: r for r in dimensions.enrich_as_of(requests, names, names, places, sources).collect()}
    assert (full[1]["department_name_sq"], full[1]["category_name_en"], full[1]["location_zone"], full[1]["source_filename"]) == ("A", "Y", "north", "s.csv")
    assert full[2]["department_name_sq"] is full[2]["location_zone"] is None
    assert requests.where(F.lit(False)).count() == 0
