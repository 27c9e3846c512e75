"""Trends, sketches, personal data and the golden set against plain computations."""

import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from servicelens.operators import golden, personal, quality, signals, sketches
from servicelens.tables import values_table


def slow_trend(values):
    n = len(values)
    pairs = list(itertools.combinations(range(n), 2))
    s = sum((values[j] > values[i]) - (values[j] < values[i]) for i, j in pairs)
    ties = [values.count(v) for v in set(values)]
    variance = (n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in ties)) / 18
    z = (s - (s > 0) + (s < 0)) / math.sqrt(variance) if variance else 0.0
    slope = statistics.median([(values[j] - values[i]) / (j - i) for i, j in pairs]) if pairs else None
    return s, z, math.erfc(abs(z) / math.sqrt(2)), slope


def test_trends_against_all_pairs(spark):
    rng = random.Random(1)
    series = {
        "up": [i + rng.random() * 4 for i in range(40)],
        "down": [-i // 3 for i in range(20)],
        "flat": [5.0] * 12,
        "noise": [rng.randrange(5) for _ in range(30)],
        "one": [1.0],
        "two": [1.0, 3.0],
        "steps": [2.0] * 9 + [7.0] * 6,
    }
    rows = [(k, i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)] + [("noise", 99, None), ("none", 1, None)]
    frame = values_table(spark, rows, "key string, day bigint, value double")
    found = {r["key"]: r for r in signals.trend_test(frame, ["key"], window=25).collect()}
    assert set(found) == set(series)
    for key, values in series.items():
        r, (s, z, p, slope) = found[key], slow_trend(values[-25:])
        assert r["s"] == s and r["z"] == pytest.approx(z, abs=1e-9) and r["p_value"] == pytest.approx(p, abs=2e-7)
        assert r["slope"] == (None if slope is None else pytest.approx(slope, abs=1e-9))
    assert {k: r["trend"] for k, r in found.items()} == {
        "up": "up", "down": "down", "flat": "none", "noise": "none", "one": None, "two": None, "steps": "up"
    }
    assert (found["steps"]["change_at"], found["steps"]["change"]) == (9, 5.0)
    assert found["flat"]["change_at"] is None and found["flat"]["p_value"] == pytest.approx(1.0, abs=1e-6)


def test_sketches_merge_to_the_profile_of_all_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"s{i % 4}", i, rng.gauss(0, 1), rng.choice("aaabbc") if i % 7 else None, i % 500) for i in range(4000)]
    frame = spark.createDataFrame(rows, "source string, id bigint, x double, kind string, few bigint")
    names, kept = ["id", "x", "kind", "few"], str(tmp_path / "kept")
    for _ in range(2):  # a source given again replaces its sketches
        sketches.keep_sketches(sketches.sketch(frame, "source", names), kept, "source")
    profile = {r["column"]: r for r in sketches.merged_profile(sketches.read_sketches(spark, kept)).collect()}
    exact = {r["column"]: r["distinct_values"] for r in quality.distinct_counts(frame, names).collect()}
    assert exact == {"id": 4000, "x": 4000, "kind": 3, "few": 500}
    for name in names:
        r = profile[name]
        assert r["rows"] == 4000 and r["distinct_low"] <= exact[name] <= r["distinct_high"]
        values = [row[names.index(name) + 1] for row in rows]
        assert r["nulls"] == values.count(None)
        if name == "kind":
            assert r["quartiles"] is None
            counts = {v: values.count(v) for v in "abc"}
            assert {f["item"]: f["count"] for f in r["frequent"] if f["item"]}.items() <= counts.items()
            assert r["frequent"][0]["item"] == "a" and (r["min_value"], r["max_value"]) == ("a", "c")
        else:
            assert (float(r["min_value"]), float(r["max_value"])) == (min(values), max(values))
            for q, share in zip(r["quartiles"], (0.25, 0.5, 0.75), strict=True):
                assert abs(sum(v <= q for v in values) / 4000 - share) < 2 * sketches.QUANTILE_ERROR
    by_source = sketches.merged_profile(sketches.read_sketches(spark, kept).where("source = 's1'"), ["source"]).collect()
    assert {r["rows"] for r in by_source} == {1000}


CASES = [
    ("phone", "call +1 (826) 555-4081 now", True),
    ("phone", "+355 69 123 4567", True),
    ("phone", "0691234567", True),
    ("phone", "04/222-33-44", True),
    ("phone", "00355 42 22 3344", True),
    ("phone", "1000000", False),
    ("phone", "4123456789", False),
    ("phone", "233.254.104.120", False),
    ("phone", "2024-01-15 10:30:00", False),
    ("phone", "980791576280", False),
    ("phone", "1009 0123456 00", False),
    ("phone", "12.3456789", False),
    ("email", "mail ana.b@mail.example.com.", True),
    ("email", "@home or a@b", False),
    ("card", "4111 1111 1111 1111", True),
    ("card", "4111-1111-1111-1112", False),
    ("card", "5500005555555559", True),
    ("card", "AL052121 1009 1234 5678 00", False),
    ("account", "GB82 WEST 1234 5698 7654 32", True),
    ("account", "GB83 WEST 1234 5698 7654 32", False),
    ("account", "DE89370400440532013000", True),
    ("id_number", "K12312345L", False),
    ("id_number", "A80131123C", False),
    ("id_number", "A80113112C", True),
    ("id_number", "A86231123C", False),
]


@pytest.mark.parametrize(("kind", "text", "expected"), CASES)
def test_personal_rules(spark, kind, text, expected):
    frame = values_table(spark, [(text,)], "t string").select((F.size(personal.found(F.col("t"), kind)) > 0).alias("hit"))
    assert bool(frame.first()["hit"]) is expected


def test_check_digits_against_plain_sums(spark):
    rng = random.Random(3)
    cards = ["".join(rng.choice("0123456789") for _ in range(rng.randrange(13, 20))) for _ in range(300)]

    def slow(number):
        total = 0
        for i, c in enumerate(reversed(number)):
            d = int(c) * (1 + i % 2)
            total += d - 9 * (d > 9)
        return total % 10 == 0

    found = values_table(spark, [(c,) for c in cards], "t string").select("t", personal.luhn(F.col("t")).alias("ok")).collect()
    assert {r["t"]: r["ok"] for r in found} == {c: slow(c) for c in cards}


def test_keys_are_kept_and_phones_dropped(spark):
    frame = spark.range(2_000_000, 2_000_400).select(
        "id",
        F.col("id").cast("string").alias("key"),
        (F.col("id") * 3571).cast("string").alias("long_key"),
        F.concat(F.lit("+355 69 "), F.substring(F.col("id").cast("string"), 1, 3), F.lit(" "), F.substring(F.col("id").cast("string"), 4, 4)).alias("reach"),
        F.lit(None).cast("string").alias("nothing"),
        F.lit(1).alias("phone_nr"),
    )
    for rules in (personal.personal_columns(frame), quality.pii_profile(frame)):
        kept = quality.drop_pii(frame, rules).columns
        assert "id" in kept and "reach" not in kept and "phone_nr" not in kept and "nothing" in kept
    assert quality.drop_pii(frame, personal.personal_columns(frame)).columns == ["id", "key", "long_key", "nothing"]
    rates = {(r["column"], r["kind"]): r["rate"] for r in personal.personal_columns(frame).collect()}
    assert rates["reach", "phone"] == 1.0 and rates["key", "phone"] == rates["nothing", "phone"] == 0.0
    assert personal.personal_columns(frame.limit(0)).where("rate > 0 or given > 0").isEmpty()


def test_long_keys_are_no_cards(spark):
    """Keys of 13 digits and more have Luhn's digit by chance; cards without separators have it throughout."""

    def card(n):
        stem = str(4000_0000_0000_000 + n * 7919)
        total = sum(d - 9 * (d > 9) for d in (int(c) * (1 + (i + 1) % 2) for i, c in enumerate(reversed(stem))))
        return stem + str(-total % 10)

    rows = [(str((n + 998_990) * 1_000_003 + 1_000_000_000), card(n), f"paid {card(n)}", card(n) if n < 5 else "1") for n in range(400)]
    frame = values_table(spark, rows, "long_key string, cards string, texts string, few string")
    hits = {r["column"]: r["hits"] for r in personal.personal_columns(frame).where("kind = 'card'").collect()}
    assert hits == {"long_key": 0, "cards": 400, "texts": 400, "few": 0}
    assert personal.personal_columns(frame.limit(3)).where("kind = 'card' and column = 'long_key' and hits > 0").isEmpty()


def test_personal_columns_of_large_ids_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from servicelens.plans import insights

    docs = spark.range(998_900, 999_400).selectExpr(
        "id AS doc_id", "concat('card 4111111111111111, or ', id) AS text", "'en' AS lang", "'s' AS source", "10L AS n_chars"
    )
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = insights.QUERIES["personal_columns"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = db.execute(insights.ORACLE["personal_columns"])
    names = [d[0] for d in wanted.description]
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(wanted.fetchall())


def test_masked_text(spark):
    frame = values_table(spark, [("mail a@b.com or +1 (826) 555-4081", 1), (None, 2), ("key 1000000", 3)], "t string, n int")
    assert [r["t"] for r in personal.masked(frame, ["t"]).orderBy("n").collect()] == ["mail [email] or [phone]", None, "key 1000000"]


ANSWERS = "q string, department string, value double, n bigint"


def test_golden_answers_are_sets_of_rows(spark):
    expected = [("equal", "a", 1.0, 1), ("equal", "b", 2.0, 2), ("equal", "b", 2.0, 2), ("within", "a", 1.0, 1), ("within", None, 3.0, 1)]
    expected += [("wrong", "a", 1.0, 1), ("fewer", "a", 1.0, 1), ("fewer", "a", 1.0, 1), ("missing", "a", 1.0, 1), ("nulls", None, None, None)]
    expected += [("swapped", "a", 1.0, 1), ("swapped", "b", 2.0, 1)]
    actual = [("equal", "b", 2.0, 2), ("equal", "a", 1.0, 1), ("equal", "b", 2.0, 2), ("within", "a", 1.0000009, 1), ("within", None, 3.0, 1)]
    actual += [("wrong", "a", 1.00001, 1), ("fewer", "a", 1.0, 1), ("unexpected", "a", 1.0, 1), ("nulls", None, None, None)]
    actual += [("swapped", "a", 2.0, 1), ("swapped", "b", 1.0, 1)]
    compared = golden.compare_answers(values_table(spark, expected, ANSWERS), values_table(spark, actual, ANSWERS), ["q"])
    verdicts = {r["q"]: r["verdict"] for r in compared.collect()}
    assert verdicts == {
        "equal": "equal", "within": "within", "wrong": "wrong", "fewer": "wrong", "missing": "missing",
        "unexpected": "unexpected", "nulls": "equal", "swapped": "wrong",
    }
    score = golden.accuracy(compared).first()
    assert (score["questions"], score["correct"]) == (8, 3)


def test_fingerprints_do_not_depend_on_order_or_partitions(spark):
    rows = [("x", f"d{i % 5}", i / 7, i) for i in range(100)]
    prints = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        frame = spark.createDataFrame(rows, ANSWERS).repartition(seed + 1)
        prints.add(tuple(golden.fingerprints(frame, ["q"]).first()))
    assert len(prints) == 1
    other = spark.createDataFrame([*rows[1:], ("x", "d0", 0.5, 1)], ANSWERS)
    assert tuple(golden.fingerprints(other, ["q"]).first()) not in prints
