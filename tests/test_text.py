import datetime as dt

import pytest
from pyspark.sql import functions as F

from servicelens.functions import text as tx
from servicelens.operators import labels


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "number, locale, digits, shown",
    [
        (1248, "sq", 0, "1.248"),
        (87.4, "sq", 1, "87,4"),
        (1248, "en", 0, "1,248"),
        (1234567.25, "en", 1, "1,234,567.3"),
        (0.25, "en", 1, "0.3"),
        (2.5, "en", 0, "3"),
        (-0.04, "en", 1, "-0.0"),
        (-1234.5, "sq", 1, "-1.234,5"),
        (0, "en", 1, "0.0"),
    ],
)
def test_numbers(spark, number, locale, digits, shown):
    assert value(spark, tx.format_decimal(F.lit(number), locale, digits)) == shown


def test_months_dates_and_periods(spark):
    day = F.lit(dt.date(2026, 9, 18))
    assert value(spark, tx.source_date(day, "sq")) == "18 sht"
    assert value(spark, tx.month_label(F.lit(4), "en")) == "Apr"
    assert value(spark, tx.period_label(F.lit(dt.date(2026, 9, 1)), "sq")) == "1-24 shtator 2026"
    assert value(spark, tx.period_label(F.lit(dt.date(2026, 8, 1)), F.lit("en"), 10)) == "1-10 August 2026"


def test_signed(spark):
    assert value(spark, tx.signed(F.lit(5.58), "en")) == "+5.6"
    assert value(spark, tx.signed(F.lit(-1.2), "sq")) == "-1,2"
    assert value(spark, tx.signed(F.lit(0.0), "en")) == "+0.0"


def test_question_normalisation(spark):
    assert value(spark, tx.normalize_question(F.lit(" ﻿ How MANY?!. \n"))) == "how many"
    assert value(spark, tx.normalize_question(F.lit("how many ?"))) == "how many "


def test_templates_and_empty_cells(spark):
    assert value(spark, tx.fill(F.lit("{a} of {b}, {a}"), {"a": F.lit(1), "b": F.lit("x")})) == "1 of x, 1"
    assert value(spark, tx.label_empty(F.lit(""), "Empty")) == "Empty"
    assert value(spark, tx.label_empty(F.lit(None).cast("string"), "Bosh")) == "Bosh"
    assert value(spark, tx.label_empty(F.lit(" "), "Empty")) == " "


def test_round_half_up(spark):
    assert [value(spark, tx.round_half_up(F.lit(x))) for x in (2.5, -2.5, 2.4)] == [3, -2, 2]


def test_labels_cover_both_locales(spark):
    assert labels.label_table(spark).groupBy("key").count().where("count <> 2").count() == 0
    keys = spark.createDataFrame([("departments.public",), ("parks",)], "key string")
    shown = {r.key: r.label for r in labels.localize(keys, labels.label_table(spark), "key", "sq").collect()}
    assert shown == {"departments.public": "Shërbimet publike", "parks": "parks"}
