"""Monthly briefing: facts per period and the report lines in two languages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import DEFAULT_DAYS
from ..functions.text import fill, format_decimal, month_name, period_label
from .kpi import ALL
from .labels import LOCALES, department_name, number_word, text
from .requests import MEASURES


def briefing_facts(kpi: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """One row per period: the totals, the number of departments, the largest queue and volume.

    With the output of `growth` the change of the city's on-time rate is a fact as well, with that of
    `signals` the number of departments with an anomaly. `inventory` adds the number of stale sources.
    """
    is_total = F.col("department") == ALL

    def largest(measure: str) -> Column:
        """The department with most of it, by name when two tie."""
        order = F.when(~is_total, F.struct(-F.col(measure), F.col("department")))
        return F.min_by("department", order)

    change = F.col("rate_change") if "rate_change" in kpi.columns else F.lit(None).cast("double")
    facts = kpi.groupBy("period").agg(
        *[F.sum(F.when(is_total, F.col(m))).alias(m) for m in MEASURES],
        F.max(F.when(is_total, F.col("on_time_rate"))).alias("on_time_rate"),
        F.count_if(~is_total).alias("departments"),
        F.max(F.when(is_total, change)).alias("rate_change"),
        largest("overdue").alias("top_department"),
        largest("received").alias("busiest_department"),
        F.max(F.when(~is_total, F.col("overdue"))).alias("top_overdue"),
        *([F.count_if(~is_total & F.col("is_anomaly")).alias("anomalies")] if "is_anomaly" in kpi.columns else []),
    )
    if inventory is not None:
        stale = inventory.where("stale").groupBy("period").agg(F.count_distinct("id").alias("stale_sources"))
        facts = facts.join(stale, "period", "left").withColumn(
            "stale_sources", F.coalesce("stale_sources", F.lit(0))
        )
    return facts


def briefing_lines(
    facts: DataFrame,
    inventory: DataFrame,
    locales: Sequence[str] = LOCALES,
    n_days: int = DEFAULT_DAYS,
    title: str | None = None,
    footer: str | None = None,
) -> DataFrame:
    """(period, locale, line_no, text): the report as rows in the order (line_no, text).

    All figures are computed. `inventory(period, department, filename, updated, stale)` adds to the
    report of a month a line per stale department and one per file, which share their `line_no`. The facts are read once: every
    line starts as a slot of a facts row, and slots for files are filled by a join.
    """
    locale = F.col("locale")

    def whole(name: str) -> Column:
        return format_decimal(name, locale)

    rate = format_decimal("on_time_rate", locale, 1)
    department = department_name(F.col("top_department"), locale)
    heading = text("briefingHeading", locale)
    if title:
        heading = F.concat(F.lit(f"{title}: "), heading)

    def headline(shown: Column) -> Column:
        return F.concat(F.lit("## "), shown)

    def bullet(key: str, value: Column) -> Column:
        return F.concat(F.lit("- "), text(key, locale), F.lit(": "), value)

    intro = {
        "received": whole("received"),
        "departments": number_word("departments", locale),
        "resolved": whole("resolved"),
        "rate": rate,
    }
    # What the figures support, and no line when they support neither.
    lead = F.nullif(
        F.concat_ws(
            " ",
            F.when(F.col("rate_change") > 0, text("leadImproving", locale)),
            F.when(F.col("overdue") > 0, text("leadQueue", locale)),
        ),
        F.lit(""),
    )
    queue = {"department": department, "count": whole("top_overdue"), "total": whole("overdue")}
    lines = [
        ("", F.concat(F.lit("# "), heading)),
        ("", F.concat_ws(" | ", text("draft", locale), period_label("period", locale, n_days))),
        ("", headline(text("executiveSummary", locale))),
        ("lead", lead),
        ("", fill(text("briefingIntro", locale), intro)),
        ("", bullet("received", whole("received"))),
        ("", bullet("onTime", F.concat(rate, F.lit("%")))),
        ("", bullet("overdue", whole("overdue"))),
        ("", headline(fill(text("briefingPriority", locale), queue))),
        ("", fill(text("briefingPriorityBody", locale), queue)),
        ("", headline(text("briefingQuality", locale))),
        ("stale", F.lit(None).cast("string")),
        ("", fill(text("briefingComparison", locale), {"days": F.lit(str(n_days))})),
        ("", headline(text("connectedSources", locale))),
        ("file", F.lit(None).cast("string")),
    ]
    if footer:
        lines.append(("", F.lit(footer)))
    slots = F.array(
        *[
            F.struct(
                F.lit(n).cast("long").alias("line_no"),
                F.lit(slot).alias("slot"),
                shown.alias("fixed_text"),
            )
            for n, (slot, shown) in enumerate(lines, start=1)
        ]
    )
    localised = F.explode(F.array(*[F.lit(x) for x in locales])).alias("locale")
    report = facts.select("*", localised).select("period", "locale", F.inline(slots))

    updated = F.concat_ws(" ", F.dayofmonth("updated"), month_name(F.month("updated"), locale))
    source = {"source": department_name(F.col("department"), locale), "date": updated}
    filled = F.array(
        F.when(
            F.col("stale"),
            F.struct(
                F.lit("stale").alias("slot"),
                fill(text("briefingStale", locale), source).alias("file_text"),
            ),
        ),
        F.struct(
            F.lit("file").alias("slot"), F.concat(F.lit("- "), F.col("filename")).alias("file_text")
        ),
    )
    file_lines = (
        inventory.select("*", localised)
        .select("period", "locale", F.inline(F.array_compact(filled)))
        .distinct()
    )
    return (
        report.join(file_lines, ["period", "locale", "slot"], "left")
        .where(F.col("fixed_text").isNotNull() | F.col("file_text").isNotNull())
        .select(
            "period",
            "locale",
            "line_no",
            F.coalesce("fixed_text", "file_text").alias("text"),
        )
    )
