"""Reports of decisions and checks: trends, sketched profiles, personal data, the golden set, guarded statements."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import DEFAULT_DAYS, in_window, month_of
from ..operators import golden, kpi, personal, quality, signals, sketches
from ..session import staging_path
from ..sources import statements
from ..tables import values_table
from . import canonical, oracle, queries
from .queries import rounded

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---- trends

DAYS, MONTHS = 30, 24
_MEASURES = ("z", "p_value", "slope", "change")


@query
def trend_decisions(spark, path):
    """Whether the events of each type rise or fall over their last days."""
    return signals.trend_test(queries._daily(spark, path), ["event_type"], window=DAYS).withColumns(rounded(*_MEASURES))


@query
def kpi_trends(spark, path):
    """Whether the on-time rate of each department, and of all, rises or falls over the last months."""
    monthly = queries._kpi(spark, path)
    return signals.trend_test(monthly, ["department"], "period", "on_time_rate", MONTHS).withColumns(rounded(*_MEASURES))


def _trend_sql(source: str, key: str, at: str, value: str, window: int) -> str:
    """The test in its plain form: all pairs of points."""
    return f"""newest AS (
  SELECT {key} AS k, {at} AS d, CAST({value} AS DOUBLE) AS v FROM {source}
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {at} DESC) <= {window}
), pts AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) AS i, count(*) OVER (PARTITION BY k) AS n,
    avg(v) OVER (PARTITION BY k) AS m FROM newest
), pairs AS (
  SELECT a.k, sum(sign(b.v - a.v)) AS s, median((b.v - a.v) / (b.i - a.i)) AS slope
  FROM pts a JOIN pts b ON a.k = b.k AND b.i > a.i GROUP BY 1
), tied AS (
  SELECT k, sum(t * (t - 1) * (2 * t + 5)) AS ties FROM (SELECT k, v, count(*) AS t FROM pts GROUP BY 1, 2) GROUP BY 1
), drift AS (
  SELECT k, i, n, round(abs(sum(v) OVER (PARTITION BY k ORDER BY i) - i * m), 9) AS off FROM pts
), turn AS (
  SELECT k, i FROM drift WHERE i < n AND off > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY off DESC, i) = 1
), means AS (
  SELECT p.k, min(p.d) FILTER (p.i > t.i) AS change_at,
    avg(v) FILTER (p.i > t.i) - avg(v) FILTER (p.i <= t.i) AS change
  FROM pts p JOIN turn t ON p.k = t.k GROUP BY 1
), sizes AS (SELECT k, count(*) AS n FROM pts GROUP BY 1
), scored AS (
  SELECT k, n, coalesce(s, 0) AS s, slope, ties,
    CASE WHEN n * (n - 1) * (2 * n + 5) - ties > 0
      THEN (coalesce(s, 0) - sign(coalesce(s, 0))) / sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18.0) ELSE 0.0 END AS z
  FROM sizes LEFT JOIN pairs USING (k) LEFT JOIN tied USING (k)
), judged AS (
  SELECT *, (0.254829592 * t - 0.284496736 * t ** 2 + 1.421413741 * t ** 3 - 1.453152027 * t ** 4 + 1.061405429 * t ** 5)
    * exp(-z * z / 2) AS p FROM (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM scored)
)
SELECT k AS {key}, n AS points, CAST(s AS BIGINT) AS s, round(z, 6) AS z, round(p, 6) AS p_value,
  CASE WHEN n < 3 THEN NULL WHEN p <= 0.05 AND s > 0 THEN 'up' WHEN p <= 0.05 AND s < 0 THEN 'down' ELSE 'none' END AS trend,
  round(slope, 6) AS slope, change_at, round(change, 6) AS change
FROM judged LEFT JOIN means USING (k)"""


# ---- sketched profiles

_PROFILED = ["event_id", "ts", "user_id", "value", "props"]


@query
def sketched_profile(spark, path):
    """Profile of the events from the sketches kept of each type, and whether exact figures bear it out."""
    events = canonical.table(spark, path, "events")
    out = staging_path(spark, "sketches")
    sketches.keep_sketches(sketches.sketch(events, "event_type", _PROFILED), out, "event_type")
    profile = sketches.merged_profile(sketches.read_sketches(spark, out))

    exact = quality.distinct_counts(events, _PROFILED).withColumnRenamed("distinct_values", "exact")
    long = [F.struct(F.lit(c).alias("column"), sketches._number(F.col(c), events.schema[c].dataType).alias("v")) for c in _PROFILED]
    ranks = profile.where(F.col("quartiles").isNotNull()).select("column", "quartiles")
    counted = (
        events.select(F.inline(F.array(*long)))
        .where(F.col("v").isNotNull())
        .join(ranks, "column")
        .groupBy("column")
        .agg(
            *[F.avg((F.col("v") < F.get("quartiles", F.lit(i))).cast("double")).alias(f"below{i}") for i in range(3)],
            *[F.avg((F.col("v") <= F.get("quartiles", F.lit(i))).cast("double")).alias(f"upto{i}") for i in range(3)],
        )
    )
    slack = 2 * sketches.QUANTILE_ERROR
    near = F.lit(True)
    for i, q in enumerate((0.25, 0.5, 0.75)):
        near &= (F.col(f"below{i}") <= q + slack) & (F.col(f"upto{i}") >= q - slack)
    checked = counted.select("column", near.alias("quartiles_within"))
    largest = (
        events.groupBy("props").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).select(F.lit("props").alias("column"), "n")
    )
    off = F.abs(F.get("frequent", F.lit(0))["count"] - F.col("n")) <= sketches.FREQUENT_ERROR * F.col("rows")
    return (
        profile.join(exact, "column", "left")
        .join(checked, "column", "left")
        .join(largest, "column", "left")
        .select(
            "column",
            "type",
            "rows",
            "nulls",
            "min_value",
            "max_value",
            F.col("exact").alias("distinct_values"),
            F.col("exact").between(F.col("distinct_low"), F.col("distinct_high")).alias("distinct_within"),
            "quartiles_within",
            off.alias("frequent_within"),
        )
    )


# ---- personal data


def _with_planted(docs: DataFrame) -> DataFrame:
    """The documents with columns of keys and of personal data made from their ids."""
    n = F.col("doc_id")
    ten = F.lpad((n * 7919 % 10000000).cast("string"), 7, "0")
    phone = F.concat(F.lit("+355 69 "), F.substring(ten, 1, 3), F.lit(" "), F.substring(ten, 4, 4))
    card = F.concat(F.lit("4000 0000 0"), F.substring(ten, 1, 3), F.lit(" "), F.substring(ten, 4, 4))
    month, day = F.lpad((n % 20).cast("string"), 2, "0"), F.lpad((n % 37).cast("string"), 2, "0")
    number = F.concat(F.lit("A8"), (n % 10).cast("string"), month, day, F.lit("12C"))
    account = F.concat(F.lit("AL"), F.lpad((n % 97 + 2).cast("string"), 2, "0"), F.lit("2121 1009 "), ten, F.lit("00"))
    return docs.select(
        (n + 1_000_000).alias("doc_key"),
        (n + 1_000_000).cast("string").alias("key_text"),
        (n * 1_000_003 + 1_000_000_000).cast("string").alias("long_key"),
        F.when(n % 3 == 0, phone).when(n % 3 == 1, ten).alias("reach"),
        card.alias("paid_with"),
        number.alias("holder"),
        account.alias("from_account"),
        (n % 5).alias("phone_nr"),
        "text",
    )


@query
def personal_columns(spark, path):
    """Which columns hold personal data; keys of seven digits and more do not."""
    planted = _with_planted(canonical.table(spark, path, "documents"))
    return personal.personal_columns(planted, min_rate=0.02).withColumns(rounded("rate"))


@query
def safe_columns(spark, path):
    """What is left once personal columns are dropped: the keys are."""
    planted = _with_planted(canonical.table(spark, path, "documents"))
    safe = quality.drop_pii(planted, personal.personal_columns(planted, min_rate=0.02))
    return quality.profile(safe).select("column", "type", "rows", "nulls")


_PLANTED = """planted AS (
  SELECT doc_id AS n, lpad(CAST(doc_id * 7919 % 10000000 AS VARCHAR), 7, '0') AS t, coalesce(text, '') AS text,
    text IS NOT NULL AS given, lpad(CAST(doc_id % 97 + 2 AS VARCHAR), 2, '0') AS check2 FROM documents
), cards AS (
  SELECT n, sum(CASE WHEN (16 - i) % 2 = 0 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END) % 10 = 0 AS ok
  FROM (SELECT n, i, CAST(substring('400000000' || t, CAST(i AS INTEGER), 1) AS INTEGER) AS d
        FROM planted, range(1, 17) AS r(i)) GROUP BY n
), accounts AS (
  SELECT n, CAST('21211009' || t || '00' || '1021' || check2 AS HUGEINT) % 97 = 1 AS ok FROM planted
), hits AS (
  SELECT count(*) AS rows, count(*) FILTER (n % 3 = 0) AS phones, count(*) FILTER (n % 3 <> 2) AS reached,
    count(*) FILTER (n % 20 BETWEEN 1 AND 12 AND n % 37 BETWEEN 1 AND 31) AS numbers, count(*) FILTER (given) AS texts,
    (SELECT count(*) FROM cards WHERE ok) AS cards, (SELECT count(*) FROM accounts WHERE ok) AS accounts,
    count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+\\.)+[A-Za-z]{2,}')) AS emails
  FROM planted
)"""


def _personal_sql() -> str:
    """Rows of columns and kinds; the kinds of a text are looked for by patterns of their own."""
    spots = {
        "phone": (
            r"(?:^|[^A-Za-z0-9.+-])(\+[1-9][0-9]{0,2}[ ./-]?\(?[0-9]{2,4}\)?(?:[ ./-]?[0-9]{2,4}){1,3})(?:$|[^A-Za-z0-9])",
            "length(regexp_replace(x, '[^0-9]', '', 'g')) >= 8",
        ),
        "home": (
            r"(?:^[ /]?|[^A-Za-z0-9.+ /-]|[^0-9][ /])((?:00[1-9][0-9]{0,2}[ ./-]?|\(?0[1-9][0-9]{0,2}\)?)(?:[ ./-]?[0-9]{2,4}){2,4})"
            r"(?:$|[^A-Za-z0-9 ]| $| [^0-9])",
            "CASE WHEN x LIKE '00%' THEN length(regexp_replace(x, '[^0-9]', '', 'g')) >= 10"
            " ELSE length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 11 END",
        ),
        "id_number": (
            r"(?:^|[^A-Za-z0-9])([A-Z][0-9]{8}[A-Z])(?:$|[^A-Za-z0-9])",
            "CAST(x[4:5] AS INTEGER) % 50 BETWEEN 1 AND 12 AND CAST(x[6:7] AS INTEGER) BETWEEN 1 AND 31",
        ),
        "card": (
            r"(?:^[ /]?|[^A-Za-z0-9.+ /-]|[^0-9][ /])([1-9][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7})"
            r"(?:$|[^A-Za-z0-9 ]| $| [^0-9])",
            "list_sum(list_transform(string_split(reverse(regexp_replace(x, '[^0-9]', '', 'g')), ''), lambda c, i: "
            "CASE WHEN i % 2 = 1 THEN c::INTEGER WHEN c::INTEGER > 4 THEN 2 * c::INTEGER - 9 ELSE 2 * c::INTEGER END)) % 10 = 0",
        ),
    }
    has = {k: f"len(list_filter(regexp_extract_all(text, '{p}', 1), lambda x: {ok})) > 0" for k, (p, ok) in spots.items()}
    texts = f"""texts AS (
      SELECT count(*) FILTER ({has['phone']} OR {has['home']}) AS text_phones, count(*) FILTER ({has['id_number']}) AS text_numbers,
        count(*) FILTER ({has['card']}) AS text_cards FROM planted
    )"""
    kinds = "('name'), ('email'), ('phone'), ('id_number'), ('account'), ('card')"
    columns = "('doc_key'), ('key_text'), ('long_key'), ('reach'), ('paid_with'), ('holder'), ('from_account'), ('phone_nr'), ('text')"
    return f"""{texts}, found AS (
  SELECT c AS column, k AS kind, CASE c WHEN 'reach' THEN reached WHEN 'text' THEN texts ELSE rows END AS given,
    CASE WHEN c = 'reach' AND k = 'phone' THEN phones WHEN c = 'paid_with' AND k = 'card' THEN cards
      WHEN c = 'holder' AND k = 'id_number' THEN numbers WHEN c = 'from_account' AND k = 'account' THEN accounts
      WHEN c = 'text' AND k = 'email' THEN emails WHEN c = 'text' AND k = 'phone' THEN text_phones
      WHEN c = 'text' AND k = 'id_number' THEN text_numbers WHEN c = 'text' AND k = 'card' THEN text_cards ELSE 0 END AS hits,
    c = 'phone_nr' AND k = 'phone' AS by_header
  FROM hits, texts, (VALUES {columns}) AS a(c), (VALUES {kinds}) AS b(k)
), judged AS (
  SELECT *, coalesce(hits / nullif(given, 0), 0) AS rate FROM found
)"""


# ---- golden set

WRONG, MISSING, NEAR = dt.date(2000, 9, 1), dt.date(1999, 5, 1), dt.date(1999, 6, 1)
#: The months whose queues are counted one by one.
QUEUES = [dt.date(1999 + (8 + m) // 12, (8 + m) % 12 + 1, 1) for m in range(12)]


def _answer(df: DataFrame, question: str, department: Column, value: Column) -> DataFrame:
    return df.select(
        F.lit(question).alias("question"), "period", department.alias("department"), value.cast("double").alias("value")
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def _expected(requests: DataFrame) -> DataFrame:
    """Answers counted from the requests, each in its own plain way."""
    nobody = F.lit(None).cast("string")
    received = requests.where(in_window("created_at")).groupBy(
        F.col("department_id").alias("department"), month_of("created_at").alias("period")
    )
    volume = received.agg(F.count("*").alias("n"))
    closed = requests.where(F.col("closed_at").isNotNull() & in_window("closed_at")).groupBy(
        month_of("closed_at").alias("period")
    )
    rate = closed.agg((100.0 * F.avg((F.col("closed_at") <= F.col("deadline")).cast("double"))).alias("r"))
    months = F.array(*[F.lit(m) for m in QUEUES])
    late = requests.select(
        "department_id",
        F.explode(
            F.filter(
                months,
                lambda m: (F.col("deadline") < F.date_add(m, DEFAULT_DAYS))
                & (F.col("closed_at").isNull() | (F.col("closed_at") >= F.date_add(m, DEFAULT_DAYS))),
            )
        ).alias("period"),
    )
    queues = late.groupBy("department_id", "period").agg(F.count("*").alias("n"))
    longest = queues.groupBy("period").agg(F.max(F.struct("n", "department_id")).alias("top"))
    return _union(
        [
            _answer(volume, "volume", F.col("department"), F.col("n")),
            _answer(rate, "performance", nobody, F.col("r")),
            _answer(longest, "overdue", nobody, F.col("top.n")),
        ]
    )


def _actual(monthly: DataFrame) -> DataFrame:
    """Answers from the KPI table."""
    nobody = F.lit(None).cast("string")
    parts, total = monthly.where(F.col("department") != kpi.ALL), monthly.where(F.col("department") == kpi.ALL)
    top = kpi.top_overdue(parts.where(F.col("period").isin(*QUEUES)))
    return _union(
        [
            _answer(parts.where(F.col("received") > 0), "volume", F.col("department"), F.col("received")),
            _answer(total.where(F.col("resolved") > 0), "performance", nobody, F.col("on_time_rate")),
            _answer(top, "overdue", nobody, F.col("overdue")),
        ]
    )


@query
def golden_answers(spark, path):
    """The fixed questions of every month, with three faults planted in the answers and one within tolerance."""
    expected = _expected(canonical.requests(spark, path))
    actual = _actual(queries._kpi(spark, path))
    asked, month = F.col("question"), F.col("period")
    wrong = (asked == "volume") & (month == F.lit(WRONG)) & (F.col("department") == "FURNITURE")
    near = (asked == "performance") & (month == F.lit(NEAR))
    value = F.col("value") + F.when(wrong, 1.0).when(near, 5e-6).otherwise(0.0)
    lost = (asked == "performance") & (month == F.lit(MISSING))
    extra = values_table(
        spark, [("volume", dt.date(2099, 1, 1), "FURNITURE", 1.0)], "question string, period date, department string, value double"
    )
    altered = actual.where(~lost).withColumn("value", value).unionByName(extra)
    compared = golden.compare_answers(expected, altered, ["question", "period"])
    return compared.groupBy("question", "verdict").agg(F.count("*").alias("answers"))


# ---- statements

VIEWS = ["kpi_by_month"]
STATEMENTS = [
    "select department, sum(received) as n from kpi_by_month group by department",
    "with t as (select * from kpi_by_month where department = 'all') select period, overdue from t",
    "select * from kpi_by_month where overdue > (select avg(overdue) from kpi_by_month)",
    "select * from kpi_by_month; drop table kpi_by_month",
    "drop view kpi_by_month",
    "select * from orders",
    "select * from kpi_by_month where department in (select c_name from customer)",
    "select reflect('java.lang.System', 'getenv') from kpi_by_month",
    "select * from range(10)",
    "",
]


@query
def guarded_statements(spark, path):
    """Statements from outside over the KPI view: which run, how many rows they give, why others do not."""
    queries._kpi(spark, path).createOrReplaceTempView(VIEWS[0])
    judged, ran = [], None
    for number, statement in enumerate(STATEMENTS, 1):
        verdict = statements.check_statement(spark, statement, VIEWS)
        if not verdict.allowed:
            judged.append((number, verdict.reason, None))
            continue
        rows = statements.run_statement(spark, statement, VIEWS).agg(F.count("*").alias("rows"))
        rows = rows.select(F.lit(number).cast("long").alias("statement"), F.lit("").alias("refused"), "rows")
        ran = rows if ran is None else ran.unionByName(rows)
    return ran.unionByName(values_table(spark, judged, "statement bigint, refused string, rows bigint"))


_KPIS = oracle._with(*oracle._BASE_KPI)
_LIMITED = "least(count(*), 1000)"

ORACLE = {
    "trend_decisions": oracle._with(oracle._DAILY) + ", " + _trend_sql("daily", "event_type", "day", "value", DAYS),
    "kpi_trends": _KPIS + ", " + _trend_sql("kpi", "department", "period", "on_time_rate", MONTHS),
    "sketched_profile": " UNION ALL ".join(
        f"""SELECT '{c}' AS column, '{kind}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls,
        {low} AS min_value, {high} AS max_value, count(DISTINCT {c}) AS distinct_values, true AS distinct_within,
        {'true' if number else 'NULL::BOOLEAN'} AS quartiles_within, {'true' if c == 'props' else 'NULL::BOOLEAN'} AS frequent_within
        FROM events"""
        for c, kind, number, low, high in (
            ("event_id", "bigint", True, "CAST(min(event_id) AS VARCHAR)", "CAST(max(event_id) AS VARCHAR)"),
            ("ts", "timestamp_ntz", True, "regexp_replace(CAST(min(ts) AS VARCHAR), '(\\.\\d*?)0+$', '\\1')",
             "regexp_replace(CAST(max(ts) AS VARCHAR), '(\\.\\d*?)0+$', '\\1')"),
            ("user_id", "bigint", True, "CAST(min(user_id) AS VARCHAR)", "CAST(max(user_id) AS VARCHAR)"),
            ("value", "double", True, "CAST(min(value) AS VARCHAR)", "CAST(max(value) AS VARCHAR)"),
            ("props", "string", False, "min(props)", "max(props)"),
        )
    ),
    "personal_columns": oracle._with(_PLANTED, _personal_sql())
    + """SELECT "column", kind, given, hits, round(rate, 6) AS rate, by_header,
      by_header OR (hits > 0 AND rate >= 0.02) AS flagged FROM judged""",
    "safe_columns": oracle._with(_PLANTED, _personal_sql())
    + """SELECT c AS "column", t AS type, rows, nulls FROM hits,
      (VALUES ('doc_key', 'bigint', 0), ('key_text', 'string', 0), ('long_key', 'string', 0), ('text', 'string', -1),
        ('from_account', 'string', 0)) AS v(c, t, x), LATERAL (SELECT CASE WHEN x < 0 THEN rows - texts ELSE 0 END AS nulls)
      WHERE c NOT IN (SELECT "column" FROM judged WHERE by_header OR (hits > 0 AND rate >= 0.02))""",
    "golden_answers": _KPIS
    + f"""SELECT question, verdict, count(*) AS answers FROM (
      SELECT DISTINCT 'volume' AS question, period, CASE WHEN period = DATE '{WRONG}' THEN 'wrong' ELSE 'equal' END AS verdict
      FROM kpi WHERE department <> 'all' AND received > 0
      UNION ALL SELECT 'volume', NULL, 'unexpected'
      UNION ALL SELECT 'performance', period, CASE period WHEN DATE '{MISSING}' THEN 'missing'
        WHEN DATE '{NEAR}' THEN 'within' ELSE 'equal' END FROM kpi WHERE department = 'all' AND resolved > 0
      UNION ALL SELECT DISTINCT 'overdue', period, 'equal' FROM kpi WHERE department <> 'all'
        AND period BETWEEN DATE '{QUEUES[0]}' AND DATE '{QUEUES[-1]}') GROUP BY 1, 2""",
    "guarded_statements": _KPIS
    + f"""SELECT 1 AS statement, '' AS refused, (SELECT count(DISTINCT department) FROM kpi) AS rows
    UNION ALL SELECT 2, '', (SELECT {_LIMITED} FROM kpi WHERE department = 'all')
    UNION ALL SELECT 3, '', (SELECT {_LIMITED} FROM kpi WHERE overdue > (SELECT avg(overdue) FROM kpi))
    UNION ALL SELECT statement, refused, NULL FROM (VALUES (4, 'syntax'), (5, 'command'), (6, 'relation'), (7, 'relation'),
      (8, 'function'), (9, 'node'), (10, 'empty')) AS v(statement, refused)""",
}
