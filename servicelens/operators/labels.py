"""Bilingual labels and text templates, and the lookup that localises a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import values_table

LOCALES = ("sq", "en")

# Display text by key, as (Albanian, English).
TEXT = {
    "departments.public": ("Shërbimet publike", "Public services"),
    "departments.urban": ("Urbanistika", "Urban planning"),
    "departments.social": ("Shërbimet sociale", "Social services"),
    "departments.finance": ("Financa", "Finance"),
    "emptyValue": ("Bosh", "Empty"),
    "received": ("Kërkesa të pranuara", "Requests received"),
    "resolved": ("Kërkesa të zgjidhura", "Requests resolved"),
    "onTime": ("Zgjidhur brenda afatit", "Resolved on time"),
    "overdue": ("Kërkesa të vonuara", "Overdue requests"),
    "belowTarget": ("Nën objektiv", "Below target"),
    "stale": ("Burim i vjetruar", "Outdated source"),
    "updated": ("Përditësuar", "Updated"),
    "goal": ("Objektivi: {target}% në afat", "Target: {target}% on time"),
    "noAlerts": ("Nuk ka çështje me përparësi", "No priority exceptions"),
    "noAlertsDescription": (
        "Kjo drejtori po përmbush objektivin e shërbimit.",
        "This department is meeting its service target.",
    ),
    "overdueTitle": ("{count} kërkesa jashtë afatit", "{count} requests past their deadline"),
    "overdueDescription": (
        "{department} kanë më shumë kërkesa të vonuara në këtë periudhë.",
        "{department} has the largest overdue queue in this period.",
    ),
    "staleTitle": ("Një burim ka mbetur pas", "One source is out of date"),
    "staleTitleMany": ("{count} burime kanë mbetur pas", "{count} sources are out of date"),
    "staleDescription": (
        "{department} është përditësuar për herë të fundit më {date}.",
        "{department} was last updated on {date}.",
    ),
    "csvType": (
        "Zgjidhni një skedar .csv. Eksportoni fillimisht dokumentet Excel si CSV.",
        "Choose a .csv file. Export Excel workbooks as CSV first.",
    ),
    "csvSize": (
        "Zgjidhni një CSV nën {size}, deri në {rows} rreshta dhe {columns} kolona.",
        "Choose a CSV under {size}, with up to {rows} rows and {columns} columns.",
    ),
    "noLimit": ("pa kufi", "no limit"),
    "csvError": (
        "CSV-ja nuk mund të lexohet. Kontrolloni titujt e kolonave, thonjëzat dhe gjatësinë e rreshtave.",
        "This CSV could not be read. Check the column headers, quotation marks, and row lengths.",
    ),
    "csvEmpty": (
        "Përfshini titujt e kolonave dhe të paktën një rresht me të dhëna.",
        "Include a header row and at least one data row.",
    ),
    "csvHeaders": (
        "Çdo kolonë duhet të ketë një titull unik dhe jo bosh.",
        "Each column needs a unique, non-empty header.",
    ),
    "qOverdue": (
        "Cila drejtori ka më shumë kërkesa të vonuara?",
        "Which department has the most overdue requests?",
    ),
    "qPerformance": (
        "Sa kërkesa u zgjidhën brenda afatit?",
        "How many requests were resolved on time?",
    ),
    "qVolume": (
        "Sa kërkesa u pranuan këtë muaj?",
        "How many requests did we receive this month?",
    ),
    "answerOverdue": (
        "{department} kanë {count} kërkesa të vonuara.",
        "{department} has {count} overdue requests.",
    ),
    "answerOverdueBody": (
        "Kjo përbën {share}% të {total} kërkesave të vonuara në të gjitha drejtoritë. "
        "Kjo është radha më e madhe.",
        "That is {share}% of the {total} overdue requests across all departments. This is the largest queue.",
    ),
    "answerPerformance": (
        "{rate}% e kërkesave të përfunduara u zgjidhën brenda afatit.",
        "{rate}% of completed requests were resolved on time.",
    ),
    "answerPerformanceBody": (
        "{onTime} nga {resolved} kërkesat e përfunduara respektuan afatin. Kërkesat e hapura nuk përfshihen.",
        "{onTime} of {resolved} completed requests met their deadline. Open requests are excluded.",
    ),
    "answerVolume": ("U pranuan {count} kërkesa.", "{count} requests were received."),
    "answerVolumeBody": (
        "Në {departments} drejtori, nga 1 deri më {last_day}. {department} pranuan pjesën më të madhe.",
        "Across {departments} departments, from 1 to {last_day}. {department} received the largest share.",
    ),
    "draft": ("Draft", "Draft"),
    "briefingHeading": ("Raporti i shërbimeve bashkiake", "Municipal service briefing"),
    "executiveSummary": ("Përmbledhje për drejtimin", "Executive summary"),
    "leadImproving": ("Shërbimi po përmirësohet.", "Service delivery is improving."),
    "leadQueue": (
        "Kërkesat e vonuara ende kërkojnë vëmendje.",
        "The overdue queue still needs attention.",
    ),
    "briefingIntro": (
        "Bashkia pranoi {received} kërkesa në {departments} drejtori. Nga {resolved} kërkesat e "
        "përfunduara, {rate}% u zgjidhën brenda afatit.",
        "The municipality received {received} requests across {departments} departments. Of "
        "{resolved} completed requests, {rate}% were resolved on time.",
    ),
    "briefingPriority": ("Përqendrohuni te {department}", "Focus on {department}"),
    "briefingPriorityBody": (
        "{department} kanë {count} nga {total} kërkesat e vonuara. Kontrolloni kërkesat më të vjetra "
        "dhe kategoritë e tyre para se të caktoni burime shtesë.",
        "{department} accounts for {count} of the {total} overdue requests. Review the oldest open "
        "requests and their categories before assigning additional resources.",
    ),
    "briefingQuality": ("Lexojini treguesit në kontekst", "Read the figures with their context"),
    "briefingStale": (
        "Të dhënat e burimit {source} janë përditësuar më {date}. Rezultatet janë të përkohshme.",
        "{source} data was last updated on {date}. Its results are provisional.",
    ),
    "briefingComparison": (
        "Të gjitha krahasimet mbulojnë të njëjtat {days} ditë të çdo muaji.",
        "All comparisons cover the same {days} days of each month.",
    ),
    "connectedSources": ("Skedarët burimorë", "Source files"),
}


# Small numbers in words, from one.
NUMBER_WORDS = {
    "sq": ["një", "dy", "tre", "katër", "pesë", "gjashtë", "shtatë", "tetë", "nëntë", "dhjetë"],
    "en": ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"],
}


def label_table(spark: SparkSession) -> DataFrame:
    """(locale, key, text): two rows per key."""
    rows = [(loc, key, pair[i]) for key, pair in TEXT.items() for i, loc in enumerate(LOCALES)]
    return values_table(spark, rows, "locale string, key string, text string")


def text(key: str, locale: Column | str) -> Column:
    """One label as an expression; no join."""
    sq, en = (F.lit(t) for t in TEXT[key])
    if isinstance(locale, str):
        return sq if locale == "sq" else en
    return F.when(locale == "sq", sq).otherwise(en)


def number_word(c: Column | str, locale: Column | str) -> Column:
    """One to ten in words, other numbers in digits."""
    n = F.col(c) if isinstance(c, str) else c

    def words(name: str) -> Column:
        listed = F.array(*[F.lit(w) for w in NUMBER_WORDS[name]])
        return F.coalesce(F.get(listed, n.cast("int") - 1), n.cast("string"))

    if isinstance(locale, str):
        return words(locale)
    return F.when(locale == "sq", words("sq")).otherwise(words("en"))


def department_name(column: Column | str, locale: Column | str) -> Column:
    """Display name of a known department; any other shows as stored."""
    stored = F.col(column) if isinstance(column, str) else column
    name = stored
    for key in TEXT:
        if key.startswith("departments."):
            name = F.when(stored == key.split(".", 1)[1], text(key, locale)).otherwise(name)
    return name


def localize(
    df: DataFrame, labels: DataFrame, key: Column | str, locale: str, output: str = "label"
) -> DataFrame:
    """Left join of the labels of one locale; an unknown key shows as itself.

    The labels come from `label_table` or a table of the same form; whether they are broadcast is
    left to their measured size.
    """
    wanted = labels.where(F.col("locale") == locale).select(
        F.col("key").alias("_key"), F.col("text").alias("_text")
    )
    shown = F.col(key) if isinstance(key, str) else key
    joined = df.join(wanted, shown == F.col("_key"), "left")
    return joined.withColumn(output, F.coalesce("_text", shown)).drop("_key", "_text")
