import glob

import pytest

from servicelens.operators import ask, briefing, kpi
from servicelens.sources import inventory as inv
from servicelens.sources import store
from servicelens.tables import values_table

from . import fixtures as fx


@pytest.fixture(scope="module")
def facts(spark):
    return briefing.briefing_facts(kpi.growth(kpi.kpis(fx.metrics(spark))))


@pytest.fixture(scope="module")
def stale(spark):
    return inv.stale_sources(fx.inventory(spark), fx.AS_OF)


def test_facts(facts):
    row = {r.period: r for r in facts.collect()}[fx.SEP]
    assert (row.received, row.overdue, row.departments) == (1248, 42, 4)
    assert (row.top_department, row.top_overdue) == ("public", 28)


def test_staleness_flags(stale):
    assert {r.id: r.stale for r in stale.collect()} == {row[0]: row[5] for row in fx.SOURCES}


def test_sources_of_a_department(spark, stale):
    assert [r.id for r in inv.sources_for(stale, "urban").collect()] == ["urban-requests"]
    counts = {r.department: r.sources for r in inv.source_count(stale).collect()}
    assert counts == {"all": 4, "public": 1, "urban": 1, "social": 1, "finance": 1}


def test_answers(spark, facts):
    rows = ask.answers(facts.where(facts.period == fx.SEP), "en").collect()
    got = {r.key: (r.title, r.body) for r in rows}
    assert got["overdue"][0] == "Public services has 28 overdue requests."
    assert got["overdue"][1] == (
        "That is 66.7% of the 42 overdue requests across all departments. "
        "This is the largest queue."
    )
    assert got["performance"] == (
        "87.4% of completed requests were resolved on time.",
        "993 of 1,136 completed requests met their deadline. Open requests are excluded.",
    )
    assert got["volume"] == (
        "1,248 requests were received.",
        "Across four departments, from 1 to 24 September 2026. Public services received the largest share.",
    )
    albanian = ask.answers(facts.where(facts.period == fx.SEP), "sq").collect()
    assert {r.key: r.title for r in albanian}["volume"] == "U pranuan 1.248 kërkesa."


@pytest.mark.parametrize(
    "locale, text, outcome, key",
    [
        ("en", "Which department has the most overdue requests?", "answered", "overdue"),
        ("en", "  HOW MANY REQUESTS were resolved on time?!.. ", "answered", "performance"),
        ("sq", "Sa kërkesa u pranuan këtë muaj", "answered", "volume"),
        ("en", "Sa kërkesa u pranuan këtë muaj?", "unsupported", None),
        ("en", "How many requests did we receive this month ?", "unsupported", None),
        ("en", "  \n", "empty", None),
        ("en", "", "empty", None),
        ("en", "?", "unsupported", None),
    ],
)
def test_matching_never_guesses(spark, locale, text, outcome, key):
    asked = spark.createDataFrame([(locale, text)], "locale string, text string")
    row = ask.match_questions(asked, ask.question_catalog(spark)).first()
    assert (row.outcome, row.key) == (outcome, key)


def test_report_text(spark, facts, stale, tmp_path):
    lines = briefing.briefing_lines(facts.where(facts.period == fx.SEP), stale, title="Services", footer="End")
    english = [r.text for r in lines.where("locale = 'en'").orderBy("line_no", "text").collect()]
    assert english == [
        "# Services: Municipal service briefing",
        "Draft | 1-24 September 2026",
        "## Executive summary",
        "Service delivery is improving. The overdue queue still needs attention.",
        "The municipality received 1,248 requests across four departments. Of 1,136 completed requests, 87.4% "
        "were resolved on time.",
        "- Requests received: 1,248",
        "- Resolved on time: 87.4%",
        "- Overdue requests: 42",
        "## Focus on Public services",
        "Public services accounts for 28 of the 42 overdue requests. Review the oldest open requests and their "
        "categories before assigning additional resources.",
        "## Read the figures with their context",
        "Urban planning data was last updated on 18 September. Its results are provisional.",
        "All comparisons cover the same 24 days of each month.",
        "## Source files",
        "- financa_shtator.csv",
        "- sherbimet_publike_shtator.csv",
        "- sherbimet_sociale_shtator.csv",
        "- urbanistika_shtator.csv",
        "End",
    ]
    out = str(tmp_path / "briefing")
    store.write_briefing(lines, out)
    files = glob.glob(f"{out}/period=2026-09-01/locale=*/*.txt")
    assert len(files) == 2
    albanian = next(open(f, encoding="utf-8").read() for f in files if "locale=sq" in f)
    assert albanian.startswith("# Services: Raporti i shërbimeve bashkiake\n\nDraft | 1-24 shtator 2026\n")
    assert "Bashkia pranoi 1.248 kërkesa në katër drejtori" in albanian and "87,4%" in albanian


def test_a_report_lists_the_sources_of_its_month_only(facts, stale):
    lines = briefing.briefing_lines(facts, stale)
    named = lines.where("text LIKE '%.csv' OR text LIKE '%provisional%'").select("period").distinct()
    assert facts.count() == 2 and [r.period for r in named.collect()] == [fx.SEP]


def test_report_without_sources_keeps_its_lines(spark, facts):
    nothing = values_table(spark, [], "period date, id string, department string, filename string, updated date, stale boolean")
    lines = briefing.briefing_lines(facts.where(facts.period == fx.SEP), nothing)
    assert lines.where("locale = 'en'").count() == 13
