import random

import pytest
from pyspark.sql import functions as F

from servicelens.operators import usage
from servicelens.tables import values_table

SCHEMA = "call_id bigint, model string, input_tokens bigint, output_tokens bigint, ok boolean, refusal boolean"


def ledger(spark, rows):
    return values_table(spark, rows, SCHEMA)


def test_costs(spark):
    calls = ledger(
        spark,
        [
            (1, "fast", 1000, 500, True, False),
            (2, "unheard-of", 1000, 500, True, False),
            (3, "fast", 1000, 500, False, False),
            (4, "smart", 1000, 500, False, True),
        ],
    )
    costs = {r.call_id: r.cost_usd for r in usage.price_usage(calls, usage.price_table(spark)).collect()}
    assert costs == {1: 0.0035, 2: 0.007, 3: 0.0, 4: 0.007}
    spent = {r.model: r.cost_usd for r in usage.spend(calls, usage.price_table(spark)).collect()}
    assert spent["fast"] == 0.0035


def test_empty_budget_blocks_the_first_call(spark):
    gated = usage.budget_gate(ledger(spark, [(1, "fast", 10, 5, True, False)]), usage.price_table(spark), 0.0)
    assert [r.allowed for r in gated.collect()] == [False]


def test_budget_blocks_from_the_call_after_it_is_reached(spark):
    rows = [(i, "fast", 1_000_000, 0, True, False) for i in range(6)]
    gated = usage.budget_gate(ledger(spark, rows), usage.price_table(spark), 3.0)
    assert [r.allowed for r in gated.orderBy("call_id").collect()] == [True] * 3 + [False] * 3


def test_a_blocked_call_spends_nothing(spark):
    rows = [(i, "fast", 1_000_000, 0, True, False) for i in range(6)]
    gated = usage.budget_gate(ledger(spark, rows), usage.price_table(spark), 2.5).orderBy("call_id").collect()
    assert [r.spent_before for r in gated] == [0.0, 1.0, 2.0, 3.0, 3.0, 3.0]
    assert [r.cost_usd for r in gated] == [1.0] * 3 + [0.0] * 3
    spent = usage.spend(usage.budget_gate(ledger(spark, rows), usage.price_table(spark), 2.5), usage.price_table(spark))
    assert [(r.calls, r.cost_usd) for r in spent.collect()] == [(3, 3.0)]


@pytest.mark.parametrize("parts", ["1", "2", "7", "30"])
def test_running_total_equals_brute_force(spark, parts):
    """Keys crowd in one place, so equally wide ranges would not share the work."""
    rng = random.Random(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    keys = list(range(150)) + [10**12 + rng.randrange(10**12) for _ in range(50)]
    rows = [(k, round(rng.random(), 6)) for k in dict.fromkeys(keys)]
    df = values_table(spark, rows, "k bigint, v double").repartition(5)
    got = {r.k: r.t for r in usage.running_total(df, "v", ["k"], "t").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    total = 0.0
    for k, v in sorted(rows):
        assert got[k] == pytest.approx(total, abs=1e-9)
        total += v
    assert len(got) == len(rows)


def test_running_total_of_nothing(spark):
    df = values_table(spark, [], "k bigint, v double")
    assert usage.running_total(df, "v", ["k"], "t").count() == 0


def test_outcome_codes(spark):
    rows = values_table(
        spark,
        [
            (1, False, True, None, False), (2, True, False, None, False), (3, True, True, "rate_limited", False),
            (4, True, True, "529", False), (5, True, True, "connection", False), (6, True, True, "boom", False),
            (7, True, True, None, True), (8, True, True, None, False),
        ],
        "n int, available boolean, allowed boolean, failure string, refusal boolean",
    )
    code = usage.call_outcome(F.col("available"), F.col("allowed"), F.col("failure"), F.col("refusal"))
    got = {r.n: r.code for r in rows.select("n", code.alias("code")).collect()}
    assert got == {
        1: "llm_unavailable", 2: "llm_budget_exhausted", 3: "llm_error:rate_limited", 4: "llm_error:529",
        5: "llm_error:connection", 6: "llm_error:unexpected", 7: "llm_refusal", 8: None,
    }
