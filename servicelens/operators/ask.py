"""Fixed questions: match what was asked to the catalogue and answer it with computed figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import DEFAULT_DAYS
from ..functions.text import fill, format_decimal, is_blank, month_name, normalize_question
from ..tables import values_table
from .labels import LOCALES, TEXT, department_name, number_word, text

QUESTIONS = {"overdue": "qOverdue", "performance": "qPerformance", "volume": "qVolume"}


def question_catalog(spark: SparkSession) -> DataFrame:
    """(locale, key, text)"""
    rows = [
        (locale, key, TEXT[label][i])
        for key, label in QUESTIONS.items()
        for i, locale in enumerate(LOCALES)
    ]
    return values_table(spark, rows, "locale string, key string, text string")


def match_questions(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds `key` and `outcome`: `answered`, `empty` for blank text, `unsupported` for no match.

    `asked(…, locale, text)`. Only an equal normalised text matches; nothing is guessed.
    """
    known = catalog.select(
        F.col("locale"), normalize_question("text").alias("_question"), F.col("key")
    )
    joined = asked.withColumn("_question", normalize_question("text")).join(
        known, ["locale", "_question"], "left"
    )
    outcome = (
        F.when(F.coalesce(is_blank("text"), F.lit(True)), "empty")
        .when(F.col("key").isNotNull(), "answered")
        .otherwise("unsupported")
    )
    return joined.withColumn("outcome", outcome).drop("_question")


def answers(
    facts: DataFrame, locale: str, n_days: int = DEFAULT_DAYS
) -> DataFrame:
    """(period, key, title, body) of each question, from `briefing_facts`."""

    def answer(key: str, title: Column, body: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), title.alias("title"), body.alias("body"))

    share = F.coalesce(
        100.0 * F.try_divide(F.col("top_overdue").cast("double"), F.col("overdue").cast("double")),
        F.lit(0.0),
    )
    last_day = F.concat(
        F.lit(f"{n_days} "), month_name(F.month("period"), locale), F.lit(" "), F.year("period").cast("string")
    )
    queue = {"department": department_name("top_department", locale), "count": F.col("top_overdue")}
    queue_share = {"share": format_decimal(share, locale, 1), "total": F.col("overdue")}
    rate = {"rate": format_decimal("on_time_rate", locale, 1)}
    met = {"onTime": format_decimal("on_time", locale), "resolved": format_decimal("resolved", locale)}
    volume = {
        "departments": number_word("departments", locale),
        "last_day": last_day,
        "department": department_name("busiest_department", locale),
    }
    rows = F.array(
        answer(
            "overdue",
            fill(text("answerOverdue", locale), queue),
            fill(text("answerOverdueBody", locale), queue_share),
        ),
        answer(
            "performance",
            fill(text("answerPerformance", locale), rate),
            fill(text("answerPerformanceBody", locale), met),
        ),
        answer(
            "volume",
            fill(text("answerVolume", locale), {"count": format_decimal("received", locale)}),
            fill(text("answerVolumeBody", locale), volume),
        ),
    )
    return facts.select("period", F.inline(rows))
