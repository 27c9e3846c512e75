"""The same reports as SQL over the same tables, written independently for checking results.

The SQL states each definition in its plain form (for example overdue as an inequality join), not in
the form the Spark plans use.
"""

from __future__ import annotations

from ..functions.text import LONG_MONTHS, SHORT_MONTHS
from ..operators import labels
from ..operators.kpi import ALL
from ..operators.quality import PII_HEADERS, PII_VALUES
from . import canonical
from .queries import BUDGET, TARGETS, WEIGHTS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SLA = ", ".join(f"({_text(c)}, {d})" for c, d in canonical.SLA_DAYS)

LOCATED = f"""located AS (
  SELECT o_orderkey AS id, r_name AS source_id, c_mktsegment AS department_id,
         o_orderpriority AS category_id, n_name AS location_id, o_orderdate AS created_at,
         CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'P' THEN 'in_progress' ELSE 'open' END AS status,
         CASE WHEN o_orderstatus = 'F' THEN shipped END AS closed_at,
         o_orderdate + sla_days * INTERVAL 1 DAY AS deadline
  FROM orders
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (VALUES {_SLA}) AS sla(category, sla_days) ON o_orderpriority = category
)"""


def metrics(name: str = "metrics", requests: str = "located", days: int = 24) -> str:
    """Monthly counts in their plain form; needs `located`."""
    p = name
    return f"""{p}_recv AS (
  SELECT department_id AS d, CAST(date_trunc('month', created_at) AS DATE) AS p, count(*) AS n
  FROM {requests} WHERE day(created_at) <= {days} GROUP BY 1, 2
), {p}_done AS (
  SELECT department_id AS d, CAST(date_trunc('month', closed_at) AS DATE) AS p, count(*) AS n,
         count(*) FILTER (WHERE closed_at <= deadline) AS t
  FROM {requests} WHERE closed_at IS NOT NULL AND day(closed_at) <= {days} GROUP BY 1, 2
), {p}_bounds AS (
  SELECT min(p) AS a, max(p) AS b FROM (SELECT p FROM {p}_recv UNION ALL SELECT p FROM {p}_done)
), {p}_periods AS (
  SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS p
  FROM {p}_bounds
), {p}_late AS (
  SELECT department_id AS d, p, count(*) AS n
  FROM {p}_periods JOIN {requests}
    ON deadline < p + INTERVAL {days} DAY AND (closed_at IS NULL OR closed_at >= p + INTERVAL {days} DAY)
  GROUP BY 1, 2
), {name} AS (
  SELECT g.p AS period, g.d AS department, coalesce(r.n, 0) AS received, coalesce(c.n, 0) AS resolved,
         coalesce(c.t, 0) AS on_time, coalesce(l.n, 0) AS overdue
  FROM (SELECT p, d FROM {p}_periods, (SELECT DISTINCT department_id AS d FROM {requests})) g
  LEFT JOIN {p}_recv r ON r.p = g.p AND r.d = g.d
  LEFT JOIN {p}_done c ON c.p = g.p AND c.d = g.d
  LEFT JOIN {p}_late l ON l.p = g.p AND l.d = g.d
)"""


_SUMS = ", ".join(
    f"CAST(sum({m}) AS BIGINT) AS {m}" for m in ("received", "resolved", "on_time", "overdue")
)
_RATE = "CASE WHEN resolved = 0 THEN 0.0 ELSE 100.0 * on_time::DOUBLE / resolved END AS on_time_rate"
KPI = f"""kpi AS (
  SELECT *, {_RATE} FROM (
    SELECT period, department, {_SUMS} FROM metrics GROUP BY 1, 2
    UNION ALL SELECT period, '{ALL}', {_SUMS} FROM metrics GROUP BY 1)
)"""

_TARGETS = ", ".join(
    f"({_text(d)}, DATE '{p}', {t}::DOUBLE)" for d, m, p, t in TARGETS if m == "on_time_rate"
)
CARD = f"""card AS (
  SELECT k.*, coalesce(t.target, 50.0::DOUBLE) AS target, on_time_rate >= coalesce(t.target, 50.0) AS meets_target
  FROM kpi k LEFT JOIN (VALUES {_TARGETS}) AS t(department, period, target) USING (department, period)
)"""

INVENTORY = """inventory AS (
  SELECT CAST(date_trunc('month', created_at) AS DATE) AS period, source_id AS id, department_id AS department,
         replace(lower(source_id), ' ', '_') || '.csv' AS filename,
         count(*) AS rows, CAST(max(created_at) AS DATE) AS updated,
         24 - day(max(created_at)) > 3 AS stale
  FROM located WHERE day(created_at) <= 24 GROUP BY 1, 2, 3, 4
)"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + "\n"


_BASE = (LOCATED, metrics())
_BASE_KPI = (*_BASE, KPI)
_BASE_CARD = (*_BASE_KPI, CARD, INVENTORY)
_COLUMNS = "period, department, received, resolved, on_time, overdue"

_ALERTS = """alerts AS (
  WITH queue AS (
    SELECT period, department, overdue FROM kpi WHERE department <> 'all' AND overdue > 0
    QUALIFY row_number() OVER (PARTITION BY period ORDER BY overdue DESC, department) = 1
  ), stale AS (
    SELECT c.period, c.department, n, u FROM card c
    JOIN (SELECT period, department, count(*) AS n, max(updated) AS u FROM inventory WHERE stale GROUP BY 1, 2) s
      USING (period, department)
  ), raised AS (
    SELECT period, department, 'overdue_queue' AS alert, CAST(overdue AS BIGINT) AS count,
           CAST(NULL AS DATE) AS updated FROM queue
    UNION ALL SELECT period, department, 'stale_source', n, u FROM stale
  )
  SELECT r.*, c.target FROM raised r JOIN card c USING (period, department)
  UNION ALL
  SELECT period, department, CASE WHEN meets_target THEN 'no_alerts' ELSE 'below_target' END, 0, NULL, target
  FROM card c
  WHERE NOT EXISTS (SELECT 1 FROM raised r WHERE r.period = c.period
                    AND (r.department = c.department OR c.department = 'all'))
)"""

_FACTS = """facts AS (
  SELECT t.period, t.received, t.resolved, t.on_time, t.overdue, t.on_time_rate,
         t.rate_change,
         (SELECT count(*) FROM kpi k WHERE k.period = t.period AND department <> 'all') AS departments,
         q.department AS top_department, q.overdue AS top_overdue,
         (SELECT min(department) FROM kpi k WHERE k.period = t.period AND department <> 'all'
          AND received = (SELECT max(received) FROM kpi m WHERE m.period = t.period AND department <> 'all'))
           AS busiest_department
  FROM (SELECT *, on_time_rate - lag(on_time_rate) OVER (ORDER BY period) AS rate_change
        FROM kpi WHERE department = 'all') t
  JOIN (SELECT * FROM kpi WHERE department <> 'all'
        QUALIFY row_number() OVER (PARTITION BY period ORDER BY overdue DESC, department) = 1) q USING (period)
)"""

_UNUSUAL = """unusual AS (
  SELECT *, CASE WHEN count(*) OVER w = 7 THEN avg(on_time_rate) OVER w END AS b,
         CASE WHEN count(*) OVER w = 7 THEN stddev_samp(on_time_rate) OVER w END AS s
  FROM kpi WINDOW w AS (PARTITION BY department ORDER BY period ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
)"""

_GROWTH = """growth AS (
  SELECT *, 100.0 * (received::DOUBLE / nullif(lag(received) OVER w, 0) - 1) AS received_growth,
         on_time_rate - lag(on_time_rate) OVER w AS rate_change
  FROM kpi WINDOW w AS (PARTITION BY department ORDER BY period)
)"""


def _allocated(source: str) -> str:
    """Rows (period, department, received, resolved) of allocated totals."""
    *weighted, (last, _) = WEIGHTS
    parts = [
        f"SELECT period, {_text(d)} AS department, "
        + ", ".join(f"CAST(floor({m} * {w}::DOUBLE + 0.5) AS BIGINT) AS {m}" for m in ("received", "resolved"))
        + f" FROM {source}"
        for d, w in weighted
    ]
    rest = ", ".join(
        f"CAST({m} - " + " - ".join(f"floor({m} * {w}::DOUBLE + 0.5)" for _, w in weighted) + f" AS BIGINT) AS {m}"
        for m in ("received", "resolved")
    )
    return " UNION ALL ".join([*parts, f"SELECT period, {_text(last)}, {rest} FROM {source}"])


_MONTHLY = """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS received,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS resolved FROM orders"""
_HISTORY = """history AS (
  SELECT p AS period, CAST(sum(a) AS BIGINT) AS received, CAST(sum(b) AS BIGINT) AS resolved FROM (
    SELECT p, count(*) FILTER (WHERE created_at >= p AND created_at < p + INTERVAL 24 DAY) AS a, 0 AS b
    FROM metrics_periods, located GROUP BY 1
    UNION ALL
    SELECT p, 0, count(*) FILTER (WHERE closed_at >= p AND closed_at < p + INTERVAL 24 DAY)
    FROM metrics_periods, located GROUP BY 1)
  WHERE p < DATE '1998-01-01' GROUP BY 1
)"""
_MEASURED = "period BETWEEN DATE '1998-01-01' AND DATE '2000-12-01'"

_DAILY = """daily AS (
  SELECT d.event_type, d.day, count(e.event_id) AS value
  FROM (SELECT event_type, CAST(unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)),
          INTERVAL 1 DAY)) AS DATE) AS day FROM events GROUP BY 1) d
  LEFT JOIN events e ON e.event_type = d.event_type AND CAST(e.ts AS DATE) = d.day GROUP BY 1, 2
)"""

_LEDGER = f"""ledger AS (
  SELECT *, CASE WHEN failed IS NULL THEN (input_tokens * i + output_tokens * o) / 1e6 ELSE 0.0 END AS cost_usd
  FROM (
    SELECT conv_id, turn,
           CASE turn WHEN 1 THEN 'fast' WHEN 3 THEN 'smart' ELSE 'other' END AS model,
           CAST(length(text) AS BIGINT) * 10 AS input_tokens, CAST(length(text) AS BIGINT) AS output_tokens,
           CASE WHEN length(text) > 1700 THEN 'llm_error:rate_limited' WHEN length(text) > 1600 THEN 'llm_error:503'
                WHEN length(text) > 1500 THEN 'llm_error:unexpected' END AS failed,
           length(text) < 150 AS refused,
           CASE turn WHEN 1 THEN 1.0::DOUBLE ELSE 2.0 END AS i, CASE turn WHEN 1 THEN 5.0::DOUBLE ELSE 10.0 END AS o
    FROM conversations WHERE role = 'assistant')
), gated AS (
  SELECT *, coalesce(CAST(sum(CAST(cost_usd AS DECIMAL(38, 10))) OVER (
              ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0.0) AS all_before
  FROM ledger
)"""


def _profile_events() -> str:
    kinds = {
        "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint",
        "event_type": "string", "value": "double", "props": "string",
    }

    def one(name: str, kind: str) -> str:
        shown = f"CAST({name} AS VARCHAR)"
        share = lambda test: f"round(count(*) FILTER (WHERE {test})::DOUBLE / count({name}), 6)"
        return f"""SELECT '{name}' AS "column", '{kind}' AS type, count(*) AS rows,
          count(*) - count({name}) AS nulls,
          round(100.0 * (count(*) - count({name}))::DOUBLE / count(*), 6) AS null_pct,
          CAST(min({name}) AS VARCHAR) AS min_value, CAST(max({name}) AS VARCHAR) AS max_value,
          {share(f"regexp_full_match({shown}, '[+-]?[0-9]+')")} AS reads_as_long,
          {share(f"try_cast({shown} AS DOUBLE) IS NOT NULL")} AS reads_as_double,
          {share(f"regexp_matches({shown}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')")} AS reads_as_date
          FROM events"""

    return " UNION ALL ".join(one(n, k) for n, k in kinds.items())


def _samples() -> str:
    def one(name: str) -> str:
        shown = f"CAST({name} AS VARCHAR)"
        picks = [f"arg_min({shown}, md5('{i}' || {shown}))" for i in range(3)]
        a, b, c = picks
        return f"""SELECT '{name}' AS "column", count(DISTINCT {name}) AS distinct_values,
          concat_ws(' | ', {a}, CASE WHEN {b} <> {a} THEN {b} END,
            CASE WHEN {c} NOT IN ({a}, {b}) THEN {c} END) AS samples FROM events"""

    return " UNION ALL ".join(map(one, ("event_id", "ts", "user_id", "event_type", "value", "props")))


def _pii_docs() -> str:
    import re

    columns = {"doc_id": "doc_id", "text": "text", "lang": "lang", "source_name": "source", "n_chars": "n_chars"}
    rows = []
    for shown, stored in columns.items():
        for kind, header in PII_HEADERS.items():
            named = "true" if re.search(header, shown) else "false"
            rate = "avg(0.0::DOUBLE)"
            if kind in PII_VALUES:
                rate = f"avg(CASE WHEN regexp_matches(CAST({stored} AS VARCHAR), {_text(PII_VALUES[kind])}) THEN 1.0 ELSE 0.0 END)"
            rows.append(
                f"""SELECT '{shown}' AS "column", '{kind}' AS kind, round({rate}, 6) AS rate,
                {named} AS by_header, {named} OR {rate} >= 0.05 AS flagged FROM documents"""
            )
    return " UNION ALL ".join(rows)


def _shared_columns() -> str:
    hits = " + ".join(
        f"avg(CASE WHEN regexp_matches(text, {_text(p)}) THEN 1.0 ELSE 0.0 END) >= 0.01" for p in PII_VALUES.values()
    ).replace(" + ", " OR ")
    one = (
        """SELECT '{0}' AS "column", '{1}' AS type, count(*) AS rows, count(*) - count({0}) AS nulls"""
        """ FROM documents"""
    )
    kinds = {"doc_id": "bigint", "lang": "string", "source": "string", "n_chars": "bigint"}
    plain = " UNION ALL ".join(one.format(c, k) for c, k in kinds.items())
    return f"{plain} UNION ALL {one.format('text', 'string')} HAVING NOT ({hits})"


# Question texts as they look after trimming, lower case and without closing punctuation.
_SPACE = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_CATALOG = ", ".join(
    f"('{locale}', '{key}', {_text(labels.TEXT[label][i])})"
    for key, label in (("overdue", "qOverdue"), ("performance", "qPerformance"), ("volume", "qVolume"))
    for i, locale in enumerate(labels.LOCALES)
)


def _normal(c: str) -> str:
    trimmed = f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
    return f"regexp_replace(lower({trimmed}), '[?!.]+$', '')"


def _number(c: str, digits: int, locale: str) -> str:
    scaled = f"round(abs(CAST({c} AS DOUBLE)), {digits})"
    body = f"format('{{:,.{digits}f}}', {scaled})"
    if locale == "sq":
        body = f"translate({body}, ',.', '.,')"
    return f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || {body})"


def _pick(c: str, names) -> str:
    return "(" + "CASE " + c + " " + " ".join(f"WHEN {i} THEN {_text(n)}" for i, n in enumerate(names, 1)) + " END)"


_SHORT, _LONG = SHORT_MONTHS, LONG_MONTHS


# The data has five departments.
_FIVE = {"sq": "'pesë'", "en": "'five'"}


def _period_text(locale: str) -> str:
    return f"'1-24 ' || {_pick('month(period)', _LONG[locale])} || ' ' || year(period)"


def _display() -> str:
    shown = []
    for locale, empty in (("sq", "Bosh"), ("en", "Empty")):
        sign = "CASE WHEN received_growth >= 0 THEN '+' ELSE '' END"
        shown += [
            f"{_number('overdue * 1000', 0, locale)} AS overdue_{locale}",
            f"{_number('on_time_rate', 1, locale)} AS rate_{locale}",
            f"coalesce({sign} || {_number('received_growth', 1, locale)}, '{empty}') AS growth_{locale}",
            f"{_period_text(locale)} AS label_{locale}",
            f"day(period) || ' ' || {_pick('month(period)', _SHORT[locale])} AS date_{locale}",
        ]
    return "SELECT period, department, " + ", ".join(shown) + " FROM growth"


def _briefing() -> str:
    parts = []
    for i, locale in enumerate(labels.LOCALES):
        t = {k: v[i] for k, v in labels.TEXT.items()}

        def filled(key: str, **values: str) -> str:
            out = _text(t[key])
            for name, expression in values.items():
                out = f"replace({out}, '{{{name}}}', {expression})"
            return out

        rate = _number("on_time_rate", 1, locale)
        whole = lambda c: _number(c, 0, locale)  # noqa: B023, E731
        queue = {"department": "top_department", "count": whole("top_overdue"), "total": whole("overdue")}
        lines = {
            1: f"'# Services: ' || {_text(t['briefingHeading'])}",
            2: f"{_text(t['draft'])} || ' | ' || {_period_text(locale)}",
            3: _text("## " + t["executiveSummary"]),
            5: filled(
                "briefingIntro", received=whole("received"), departments=_FIVE[locale],
                resolved=whole("resolved"), rate=rate,
            ),
            6: f"{_text('- ' + t['received'] + ': ')} || {whole('received')}",
            7: f"{_text('- ' + t['onTime'] + ': ')} || {rate} || '%'",
            8: f"{_text('- ' + t['overdue'] + ': ')} || {whole('overdue')}",
            9: "'## ' || " + filled("briefingPriority", department="top_department"),
            10: filled("briefingPriorityBody", **queue),
            11: _text("## " + t["briefingQuality"]),
            13: filled("briefingComparison", days="'24'"),
            14: _text("## " + t["connectedSources"]),
        }
        up, late = _text(t["leadImproving"]), _text(t["leadQueue"])
        parts.append(
            f"""SELECT period, '{locale}', 4, CASE WHEN rate_change > 0 AND overdue > 0 THEN {up} || ' ' || {late}
            WHEN rate_change > 0 THEN {up} ELSE {late} END FROM facts WHERE rate_change > 0 OR overdue > 0"""
        )
        for n, expression in lines.items():
            parts.append(
                f"SELECT period, '{locale}', {n}, {expression} FROM facts"
            )
        updated = f"day(updated) || ' ' || {_pick('month(updated)', _LONG[locale])}"
        stale = filled("briefingStale", source="department", date=f"({updated})")
        parts.append(f"SELECT period, '{locale}', 12, t FROM facts JOIN (SELECT DISTINCT period, {stale} AS t FROM inventory WHERE stale) USING (period)")
        parts.append(f"SELECT period, '{locale}', 15, '- ' || f FROM facts JOIN (SELECT DISTINCT period, filename AS f FROM inventory) USING (period)")
    return (
        "SELECT period, locale, CAST(line_no AS BIGINT) AS line_no, text FROM ("
        + " UNION ALL ".join(parts)
        + ") AS lines(period, locale, line_no, text)"
    )


_NOTE = """'Request "' || id || '", ' || category_id || chr(10) || 'second line'"""
_FILES = "(SELECT DISTINCT source_id, id // 50000 AS shard FROM located)"

ORACLE: dict[str, str] = {
    "kpi_monthly": _with(*_BASE_KPI)
    + f"SELECT {_COLUMNS}, round(on_time_rate, 6) AS on_time_rate FROM kpi",
    "metric_view": _with(*_BASE_KPI) + "SELECT period, department, received, overdue FROM kpi",
    "exported_metrics": _with(*_BASE) + f"SELECT {_COLUMNS} FROM metrics",
    "decoded_props": """SELECT CAST(json_extract(props, '$.k') AS VARCHAR) AS k, count(*) AS events
    FROM events GROUP BY 1""",
    "kpi_one_department": _with(
        LOCATED,
        metrics(),
        KPI,
    )
    + f"SELECT {_COLUMNS}, round(on_time_rate, 6) AS on_time_rate FROM kpi "
    "WHERE department = 'BUILDING' AND period <= DATE '1998-12-01'",
    "kpi_growth": _with(*_BASE_KPI, _GROWTH)
    + f"SELECT {_COLUMNS}, round(on_time_rate, 6) AS on_time_rate, round(received_growth, 6) AS received_growth, "
    "round(rate_change, 6) AS rate_change FROM growth",
    "overdue_snapshot": _with(*_BASE)
    + "SELECT p AS period, d AS department, n AS overdue FROM metrics_late",
    "overdue_share_top1": _with(*_BASE)
    + """SELECT period, department, overdue, round(overdue_share, 6) AS overdue_share FROM (
      SELECT period, department, overdue,
             100.0 * overdue::DOUBLE / nullif(sum(overdue) OVER (PARTITION BY period), 0) AS overdue_share
      FROM metrics)
    QUALIFY row_number() OVER (PARTITION BY period ORDER BY overdue DESC, department) = 1""",
    "most_overdue_department": _with(*_BASE)
    + """SELECT department, overdue FROM metrics WHERE period = DATE '2000-09-01'
    ORDER BY overdue DESC, department LIMIT 1""",
    "on_time_performance": _with(*_BASE)
    + """SELECT round(100.0 * sum(on_time)::DOUBLE / nullif(sum(resolved), 0), 6) AS on_time_percent
    FROM metrics WHERE period = DATE '2000-09-01'""",
    "request_volume": _with(*_BASE)
    + "SELECT CAST(sum(received) AS BIGINT) AS total_requests FROM metrics WHERE period = DATE '2000-09-01'",
    "latest_kpi": _with(*_BASE_KPI)
    + f"""SELECT {_COLUMNS}, round(on_time_rate, 6) AS on_time_rate FROM kpi
    WHERE period = (SELECT max(period) FROM kpi)""",
    "scorecard_ranked": _with(*_BASE_CARD)
    + f"""SELECT {_COLUMNS}, round(on_time_rate, 6) AS on_time_rate, target, meets_target,
    CASE WHEN department <> 'all' THEN 1 + (SELECT count(*) FROM card b WHERE b.period = card.period
      AND b.department <> 'all' AND b.on_time_rate > card.on_time_rate) END AS place FROM card""",
    "department_status": _with(*_BASE_CARD)
    + """SELECT period, department, round(on_time_rate, 6) AS on_time_rate,
      CASE WHEN s THEN 'stale' WHEN meets_target THEN 'on_target' ELSE 'below_target' END AS status,
      CASE WHEN s OR NOT meets_target THEN 'warn' ELSE 'good' END AS severity
    FROM (SELECT *, EXISTS (SELECT 1 FROM inventory i WHERE stale AND i.department = card.department
                            AND i.period = card.period) AS s FROM card)""",
    "attention": _with(*_BASE_CARD, _ALERTS) + "SELECT * FROM alerts",
    "attention_count": _with(*_BASE_CARD, _ALERTS)
    + """SELECT period, count(*) FILTER (WHERE alert IN ('overdue_queue', 'stale_source')) AS alerts
    FROM alerts GROUP BY 1""",
    "reconcile": _with(*_BASE_KPI)
    + """SELECT count(*) AS mismatches FROM (
      SELECT period FROM kpi GROUP BY period
      HAVING sum(received) <> 2 * max(received) FILTER (WHERE department = 'all')
          OR sum(resolved) <> 2 * max(resolved) FILTER (WHERE department = 'all')
          OR sum(on_time) <> 2 * max(on_time) FILTER (WHERE department = 'all')
          OR sum(overdue) <> 2 * max(overdue) FILTER (WHERE department = 'all'))""",
    "allocate_remainder": f"WITH monthly AS ({_MONTHLY} GROUP BY 1) " + _allocated("monthly"),
    "trend_union": _with(*_BASE, _HISTORY, f"parts AS ({_allocated('history')})")
    + f"""SELECT department, period, received, resolved FROM parts WHERE department = 'BUILDING'
    UNION ALL SELECT department, period, received, resolved FROM metrics
    WHERE department = 'BUILDING' AND {_MEASURED}""",
    "chart_series": _with(
        *_BASE,
        _HISTORY,
        f"""points AS (SELECT period, received, resolved FROM history
        UNION ALL SELECT period, CAST(sum(received) AS BIGINT), CAST(sum(resolved) AS BIGINT) FROM metrics
        WHERE {_MEASURED} GROUP BY 1)""",
    )
    + """SELECT 'all' AS department, period, 'received' AS measure, received AS value FROM points
    UNION ALL SELECT 'all', period, 'resolved', resolved FROM points""",
    "source_inventory": _with(LOCATED, INVENTORY)
    + "SELECT period, id, department, filename, rows, updated FROM inventory",
    "source_count": _with(LOCATED, INVENTORY)
    + """SELECT period, department, count(DISTINCT id) AS sources FROM inventory GROUP BY 1, 2
    UNION ALL SELECT period, 'all', count(DISTINCT id) FROM inventory GROUP BY 1""",
    "stale_sources": _with(LOCATED, INVENTORY)
    + "SELECT period, id, department, filename, rows, updated, stale FROM inventory WHERE department = 'BUILDING'",
    "enriched_by_zone": """SELECT r_name AS location_zone, lower(r_name) AS source_filename,
      o_orderpriority AS category_id, count(*) AS requests
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""",
    "orphan_requests": _with(LOCATED)
    + """SELECT location_id, count(*) AS requests FROM located
    WHERE location_id NOT IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey
                              WHERE r_name <> 'AFRICA') GROUP BY 1""",
    "by_zone": _with(LOCATED)
    + """SELECT r_name AS zone, count(*) AS requests,
      round(avg(CAST(split_part(location_id, '_', -1) AS DOUBLE)), 6) AS lat,
      round(-avg(CAST(split_part(location_id, '_', -1) AS DOUBLE)), 6) AS lon
    FROM located JOIN nation ON n_name = location_id JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
    "slice_status": _with(LOCATED)
    + "SELECT status, category_id, department_id, count(*) AS requests FROM located GROUP BY 1, 2, 3",
    "budget_variance": _with(
        *_BASE_KPI,
        """lines AS (SELECT c_mktsegment AS department, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
          sum(250000::DECIMAL(18, 2)) AS planned, sum(o_totalprice::DECIMAL(18, 2)) AS actual
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)""",
    )
    + """SELECT department, period, planned::DECIMAL(28, 2) AS planned, actual::DECIMAL(28, 2) AS actual,
      (actual - planned)::DECIMAL(28, 2) AS variance,
      round(100.0 * (actual - planned)::DOUBLE / planned::DOUBLE, 10) AS variance_pct,
      received, resolved, on_time, overdue, round(on_time_rate, 6) AS on_time_rate
    FROM lines LEFT JOIN kpi USING (department, period)""",
    "signals_daily": _with(_DAILY)
    + """SELECT event_type, day, value, round(b, 6) AS baseline, round(s, 6) AS spread,
      round(value - b, 6) AS deviation, round((value - b) / nullif(s, 0), 6) AS z_score,
      coalesce(CASE WHEN s = 0 THEN value <> b ELSE abs((value - b) / s) >= 2.0 END, false) AS is_anomaly
    FROM (SELECT *, CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END AS b,
                 CASE WHEN count(*) OVER w = 7 THEN stddev_samp(value) OVER w END AS s
          FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))""",
    "signals_monthly": _with(*_BASE_KPI, _UNUSUAL)
    + """SELECT period, department, round(on_time_rate, 6) AS on_time_rate, round(b, 6) AS baseline,
      round((on_time_rate - b) / nullif(s, 0), 6) AS z_score,
      coalesce(CASE WHEN s = 0 THEN on_time_rate <> b ELSE abs((on_time_rate - b) / s) >= 3.0 END, false) AS is_anomaly
    FROM unusual""",
    "trend_slope": _with(_DAILY)
    + """SELECT event_type, day, value, round(CASE WHEN count(*) OVER w = 7 THEN
        regr_slope(value, date_diff('day', DATE '1970-01-01', day)) OVER w END, 6) AS slope
    FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "profile_events": _profile_events(),
    "profile_samples": _samples(),
    "pii_profile_docs": _pii_docs(),
    "shared_columns": _shared_columns(),
    "coerce_errors": """SELECT 'event' AS "column", count(*) FILTER (WHERE event_id % 101 = 7) AS errors FROM events
    UNION ALL SELECT 'at', count(*) FILTER (WHERE event_type = 'error') FROM events
    UNION ALL SELECT 'kind', count(event_type) FROM events
    UNION ALL SELECT 'amount', count(value) FILTER (WHERE user_id % 50 = 3) FROM events
    UNION ALL SELECT 'k', count(*) FILTER (WHERE event_id % 13 = 5) FROM events""",
    "coerced_events": """SELECT CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) END AS day, count(*) AS n,
      0::BIGINT AS kinds,
      CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) FILTER (WHERE event_id % 13 <> 5) AS BIGINT) AS k
    FROM events GROUP BY 1""",
    "missing_fields": _with(LOCATED)
    + """SELECT f AS field, count(*) FILTER (WHERE v IS NULL) AS missing FROM (
      SELECT unnest(['id', 'department_id', 'created_at', 'closed_at']) AS f,
             unnest([CAST(id AS VARCHAR), department_id, CAST(created_at AS VARCHAR), CAST(closed_at AS VARCHAR)]) AS v
      FROM located WHERE status = 'closed') GROUP BY 1""",
    "ask_match": f"""WITH catalog(locale, key, text) AS (VALUES {_CATALOG}),
    starts AS (SELECT conv_id FROM conversations WHERE turn = 0),
    asked AS (
      SELECT 'en' AS locale, text FROM conversations WHERE role = 'user'
      UNION ALL SELECT locale, upper(text) || '?' FROM starts, catalog
      UNION ALL SELECT 'en', ' ' FROM starts)
    SELECT a.locale, c.key, CASE WHEN {_normal('a.text')} = '' AND regexp_full_match(a.text, '{_SPACE}*') THEN 'empty'
      WHEN c.key IS NOT NULL THEN 'answered' ELSE 'unsupported' END AS outcome, count(*) AS asked
    FROM asked a LEFT JOIN catalog c
      ON a.locale = c.locale AND {_normal('a.text')} = {_normal('c.text')}
    GROUP BY 1, 2, 3""",
    "attention_text": _with(*_BASE_CARD, _ALERTS)
    + f"""SELECT period, department, CASE alert WHEN 'overdue_queue' THEN count || ' kërkesa jashtë afatit'
        WHEN 'stale_source' THEN CASE count WHEN 1 THEN 'Një burim ka mbetur pas' ELSE count || ' burime kanë mbetur pas' END
        WHEN 'no_alerts' THEN 'Nuk ka çështje me përparësi' ELSE 'Nën objektiv' END AS title,
      CASE alert WHEN 'overdue_queue' THEN department || ' kanë më shumë kërkesa të vonuara në këtë periudhë.'
        WHEN 'stale_source' THEN department || ' është përditësuar për herë të fundit më ' || day(updated) || ' '
          || {_pick('month(updated)', _LONG['sq'])} || '.'
        WHEN 'no_alerts' THEN 'Kjo drejtori po përmbush objektivin e shërbimit.'
        ELSE 'Objektivi: ' || CAST(target AS INTEGER) || '% në afat' END AS description FROM alerts""",
    "ask_answers": _with(*_BASE_KPI, _FACTS)
    + f"""SELECT period, 'overdue' AS key,
      top_department || ' has ' || top_overdue || ' overdue requests.' AS title,
      'That is ' || {_number('(CASE WHEN overdue = 0 THEN 0.0 ELSE 100.0 * top_overdue::DOUBLE / overdue END)', 1, 'en')}
        || '% of the ' || overdue || ' overdue requests across all departments. '
        || 'This is the largest queue.' AS body FROM facts
    UNION ALL SELECT period, 'performance',
      {_number('on_time_rate', 1, 'en')} || '% of completed requests were resolved on time.',
      {_number('on_time', 0, 'en')} || ' of ' || {_number('resolved', 0, 'en')}
        || ' completed requests met their deadline. Open requests are excluded.' FROM facts
    UNION ALL SELECT period, 'volume', {_number('received', 0, 'en')} || ' requests were received.',
      'Across five departments, from 1 to 24 ' || {_pick('month(period)', _LONG['en'])} || ' ' || year(period)
        || '. ' || busiest_department || ' received the largest share.' FROM facts""",
    "usage_spend": _with(_LEDGER)
    + f"""SELECT model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
      CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd), 6) AS cost_usd
    FROM gated WHERE all_before < {BUDGET} GROUP BY 1""",
    "budget_gate": _with(_LEDGER)
    + f"""SELECT conv_id, turn, model, CASE WHEN all_before < {BUDGET} THEN round(cost_usd, 8) ELSE 0.0 END AS cost_usd,
      round(CASE WHEN all_before < {BUDGET} THEN all_before
        ELSE (SELECT sum(cost_usd) FROM gated WHERE all_before < {BUDGET}) END, 8) AS spent_before,
      all_before < {BUDGET} AS allowed FROM gated""",
    "call_outcomes": _with(_LEDGER)
    + f"""SELECT CASE WHEN conv_id % 7 = 3 THEN 'llm_unavailable' WHEN all_before >= {BUDGET} THEN 'llm_budget_exhausted' WHEN failed IS NOT NULL THEN failed
      WHEN refused THEN 'llm_refusal' ELSE 'ok' END AS outcome, count(*) AS calls FROM gated GROUP BY 1""",
    "briefing_facts": _with(*_BASE_KPI, _FACTS, INVENTORY, _UNUSUAL)
    + """SELECT period, received, resolved, on_time, overdue, round(on_time_rate, 6) AS on_time_rate, departments,
      round(rate_change, 6) AS rate_change, top_department, busiest_department, top_overdue,
      (SELECT count(DISTINCT id) FROM inventory i WHERE stale AND i.period = facts.period) AS stale_sources,
      (SELECT count(*) FROM unusual u WHERE u.period = facts.period AND department <> 'all'
       AND CASE WHEN s = 0 THEN on_time_rate <> b ELSE abs((on_time_rate - b) / s) >= 3.0 END) AS anomalies FROM facts""",
    "briefing_lines": _with(*_BASE_KPI, _FACTS, INVENTORY) + _briefing(),
    "briefing_files": _with(*_BASE_KPI, _FACTS, INVENTORY, f"lines AS ({_briefing()})")
    + """SELECT period, locale, string_agg(CASE WHEN prev IS NULL THEN ''
        WHEN starts_with(text, '- ') AND starts_with(prev, '- ') THEN chr(10)
        ELSE chr(10) || chr(10) END || text, '' ORDER BY line_no, text) || chr(10) AS text
    FROM (SELECT *, lag(text) OVER (PARTITION BY period, locale ORDER BY line_no, text) AS prev FROM lines)
    GROUP BY 1, 2""",
    "localized_status": """SELECT CASE o_orderstatus WHEN 'F' THEN 'Kërkesa të zgjidhura'
      WHEN 'P' THEN 'in_progress' ELSE 'Kërkesa të pranuara' END AS label, count(*) AS requests
    FROM orders GROUP BY 1""",
    "display_text": _with(*_BASE_KPI, _GROWTH) + _display(),
    "ingest_verdict": _with(LOCATED)
    + f"""SELECT kind, verdict, (SELECT count(*) FROM {_FILES}) AS files,
      CASE WHEN verdict = 'ok' THEN (SELECT count(*) FROM located) END AS rows
    FROM (VALUES ('good', 'ok'), ('headers', 'headers'), ('ragged', 'format'), ('unclosed', 'format'),
                 ('empty', 'empty'), ('text', 'type'), ('blank', 'ok'), ('wide', 'size'),
                 ('unmapped', 'ok'), ('faulty', 'ok')) AS v(kind, verdict)""",
    "ingest_canonical": _with(LOCATED)
    + f"""SELECT source_id, department_id AS department, status, count(*) AS requests,
      CAST(sum(id) AS BIGINT) AS id_sum, CAST(min(created_at) AS DATE) AS first_day,
      max(length({_NOTE})) AS longest_note FROM located GROUP BY 1, 2, 3""",
    "import_preview": _with(LOCATED)
    + f"""SELECT source_id AS source, id // 50000 AS shard, row_no, CAST(id AS VARCHAR) AS id,
      department_id AS department, status, {_NOTE} AS note
    FROM (SELECT *, row_number() OVER (PARTITION BY source_id, id // 50000 ORDER BY id) AS row_no FROM located)
    WHERE row_no <= 5""",
    "mapping_proposal": """SELECT kind, r_name AS source, field,
      CASE WHEN kind = 'unmapped' AND field = 'department' THEN -1 ELSE column_index END::BIGINT AS column_index,
      kind <> 'unmapped' AS valid
    FROM region, (VALUES ('good'), ('blank'), ('faulty'), ('unmapped')) AS k(kind),
      (VALUES ('id', 0), ('department', 1), ('status', 2)) AS f(field, column_index)""",
    "ingest_errors": _with(LOCATED)
    + """SELECT source_id AS source, 'id' AS field, 'type' AS problem, count(*) AS rows FROM located
      WHERE status = 'in_progress' GROUP BY 1
    UNION ALL SELECT source_id, 'department', 'missing', count(*) FROM located WHERE id % 10 = 1 GROUP BY 1
    UNION ALL SELECT source_id, 'created_at', 'type', count(*) FROM located WHERE id % 15 = 2 GROUP BY 1""",
    "source_lineage": _with(LOCATED)
    + f"""SELECT source_id AS source, CASE source_id
        WHEN 'ASIA' THEN '{{"department":"Drejtoria","id":"id","status":"Statusi"}}'
        ELSE '{{"department":"department","id":"request_id","status":"status"}}' END AS mapping_json,
      count(*) AS files FROM {_FILES} GROUP BY 1""",
    "reused_mapping": _with(LOCATED)
    + f"""SELECT source_id AS source, field, CASE source_id WHEN 'ASIA' THEN 'proposed' ELSE 'saved' END AS origin,
      column_index::BIGINT AS column_index, count(*) AS files
    FROM {_FILES}, (VALUES ('id', 0), ('department', 1), ('status', 2)) AS f(field, column_index) GROUP BY 1, 2, 3, 4""",
    "golden_accuracy": _with(*_BASE_KPI)
    + """SELECT count(*) AS questions, count(*) FILTER (WHERE ok) AS correct,
      round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS accuracy
    FROM (SELECT coalesce(r.n = k.received, false) AS ok
          FROM kpi k FULL JOIN metrics_recv r ON r.d = k.department AND r.p = k.period
          UNION ALL SELECT coalesce(r.n = k.resolved, false)
          FROM kpi k FULL JOIN metrics_done r ON r.d = k.department AND r.p = k.period)""",
}
