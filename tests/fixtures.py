"""Sample values with known results."""

import datetime as dt

from servicelens.tables import values_table

AUG, SEP = dt.date(2026, 8, 1), dt.date(2026, 9, 1)

# Fixed values: (period, department, received, resolved, on time, overdue).
METRICS = [
    (SEP, "public", 486, 420, 328, 28),
    (SEP, "urban", 312, 280, 246, 9),
    (SEP, "social", 264, 256, 249, 3),
    (SEP, "finance", 186, 180, 170, 2),
    (AUG, "public", 458, 390, 290, 16),
    (AUG, "urban", 300, 260, 217, 12),
    (AUG, "social", 250, 236, 221, 4),
    (AUG, "finance", 174, 162, 155, 2),
]

# City totals of the months before.
HISTORY = [
    (dt.date(2026, 4, 1), 894, 830),
    (dt.date(2026, 5, 1), 958, 881),
    (dt.date(2026, 6, 1), 1040, 966),
    (dt.date(2026, 7, 1), 990, 965),
]

# Fixed values: (id, department, filename, rows, updated, stale).
SOURCES = [
    ("public-requests", "public", "sherbimet_publike_shtator.csv", 486, dt.date(2026, 9, 24), False),
    ("urban-requests", "urban", "urbanistika_shtator.csv", 312, dt.date(2026, 9, 18), True),
    ("social-requests", "social", "sherbimet_sociale_shtator.csv", 264, dt.date(2026, 9, 24), False),
    ("finance-requests", "finance", "financa_shtator.csv", 186, dt.date(2026, 9, 24), False),
]
AS_OF = dt.date(2026, 9, 24)

SAMPLE_CSV = "request_id,department,status,created_at\n" + "\n".join(
    [
        "EP-001,public,open,2026-09-01",
        "EP-002,public,closed,2026-09-02",
        "EP-003,urban,open,2026-09-03",
        "EP-004,social,closed,2026-09-04",
        "EP-005,finance,closed,2026-09-05",
    ]
)


def metrics(spark):
    return values_table(
        spark,
        METRICS,
        "period date, department string, received bigint, resolved bigint, on_time bigint, overdue bigint",
    )


def history(spark):
    return values_table(spark, HISTORY, "period date, received bigint, resolved bigint")


def inventory(spark):
    return values_table(
        spark,
        [(SEP, *row[:5]) for row in SOURCES],
        "period date, id string, department string, filename string, rows bigint, updated date",
    )
