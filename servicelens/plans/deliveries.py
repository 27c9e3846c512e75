"""Reports over deliveries: the manifest, ingest with quarantine, figures kept up to date by source."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import dimensions, kpi, mapping, proposal, state
from ..session import staging_path
from ..sources import delivery, ingest, store
from ..sources import exports as csv
from ..tables import values_table
from . import canonical, exports, oracle, queries

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


TYPES = {"id": "bigint", "created_at": "date"}
PATTERNS = (*mapping.PATTERNS, ("created_at", "^created_at$"), ("note", "^note$"))
FIELDS = [field for field, _ in PATTERNS]

#: The source that is delivered twice, and where the requests of its first delivery end.
AGAIN = "ASIA"
CHANGED = dt.date(2000, 1, 1)
#: Files with more rows than this are refused in `delivery_manifest`.
MOST_ROWS = 430
#: Files above this many bytes are read in blocks in `return_exports`.
BLOCKS_ABOVE = 1000


def _take_in(spark: SparkSession, landed: tuple[DataFrame, DataFrame], out: str, number: int, sources=None) -> None:
    source = exports.path_part("source")
    ingest.ingest(spark, *landed, source, out, number, TYPES, PATTERNS, sources=sources)


@query
def ingest_outcomes(spark, path):
    """What became of every delivered row: requests, faulty rows by fault, refused files; one source came twice."""
    landed, out = queries._landed(spark, path, broken=True), staging_path(spark, "ingested")
    _take_in(spark, landed, out, 1)
    _take_in(spark, landed, out, 2, [AGAIN])
    rows = ingest.ingested(spark, out)
    # rows are counted by file first, so names of kinds and faults are made once a file
    by_file = rows.groupBy("file", "source_id", "outcome", "faults").agg(
        F.count("*").alias("rows"), F.sum("id").alias("id_sum"), F.max("delivery").alias("delivery")
    )
    counted = by_file.groupBy(
        exports.path_part("kind").alias("kind"),
        "source_id",
        "outcome",
        F.array_join(F.transform("faults", lambda f: F.concat_ws(" ", f["field"], f["problem"])), ", ").alias("faults"),
    )
    return counted.agg(
        F.sum("rows").alias("rows"),
        F.sum("id_sum").alias("id_sum"),
        F.count_distinct("file").alias("files"),
        F.max("delivery").alias("delivery"),
    )


@query
def released_rows(spark, path):
    """Faulty rows whose department was missing get one; the others stay in quarantine."""
    landed, out = queries._landed(spark, path, broken=True, kinds=("faulty",)), staging_path(spark, "ingested")
    _take_in(spark, landed, out, 1)
    faulty = ingest.quarantine(spark, out).where(F.col("outcome") == ingest.FAULTY)
    lost = F.exists("faults", lambda f: (f["field"] == "department") & (f["problem"] == "missing"))
    given = F.create_map(F.lit("department"), F.lit("UNKNOWN"))
    mended = store.save_table(
        faulty.where(lost).select("source_id", "file", "pos", given.alias("given")), staging_path(spark, "corrections")
    )
    ingest.release(spark, out, mended, TYPES, FIELDS, mapping.REQUIRED, 2)
    rows = ingest.ingested(spark, out)
    unknown = F.coalesce(F.col("department") == "UNKNOWN", F.lit(False))
    return rows.groupBy("source_id", "outcome", unknown.alias("mended")).agg(F.count("*").alias("rows"))


def _delivered(spark: SparkSession, path: str, separator: str = "\n"):
    """Two deliveries into one folder: (manifest folder, verdicts of the files of each when they came)."""
    out, manifest = staging_path(spark, "delivered"), staging_path(spark, "manifest")
    verdicts = []
    for number, years in ((1, (0, 1998)), (2, (1998, 9999))):
        exports.write_delivered(spark, path, out, years, separator)
        if number == 2:
            exports.write_empty(spark, f"{out}/source=EMPTY/year=9999")
        found = delivery.discover(spark, out)
        files = delivery.record_delivery(
            spark, delivery.new_files(found, delivery.read_manifest(spark, manifest)), manifest, number
        )
        verdicts.append(_judged(spark, out, files))
    return manifest, verdicts[0].unionByName(verdicts[1])


def _judged(spark: SparkSession, out: str, files: DataFrame) -> DataFrame:
    """Verdicts of the new files. Scans open files from the time of the first of them on."""
    since = files.agg(F.min("modified")).first()[0]
    limits = csv.FileLimits(max_rows=MOST_ROWS)
    raw = csv.raw_records(spark, out, returns=delivery.return_files(files), since=since)
    records = csv.parse_records(raw).join(files.select("file"), "file", "left_semi")
    verdicts = csv.file_verdict(spark, out, limits, records=records, files=files)
    return store.save_table(verdicts, staging_path(spark, "verdicts"))


@query
def delivery_manifest(spark, path):
    """Files, bytes and accepted rows of every delivery and source; each file is judged once."""
    manifest, verdicts = _delivered(spark, path)
    source = exports.path_part("source").alias("source")
    return delivery.delivery_summary(delivery.read_manifest(spark, manifest), verdicts, [source])


@query
def strict_read(spark, path):
    """Good exports with one header read by the strict reader under a schema; nothing in them is bad."""
    [out] = exports.kept_exports(spark, path, ["good"])
    schema = "request_id bigint, department string, status string, created_at date, note string"
    rows = csv.read_export(spark, f"{out}/locale=en", StructType.fromDDL(schema))
    return rows.groupBy("department", "status").agg(
        F.count("*").alias("requests"),
        F.sum("request_id").alias("id_sum"),
        F.max("created_at").alias("last_day"),
        F.count("_bad").alias("bad"),
    )


@query
def return_exports(spark, path):
    """Exports whose lines end with a carriage return alone, cut into blocks like any others."""
    out = staging_path(spark, "returns")
    exports.write_delivered(spark, path, out, (0, 9999), "\r")
    files = store.save_table(delivery.discover(spark, out, head_above=BLOCKS_ABOVE), staging_path(spark, "found"))
    landed = csv.land_records(
        spark, out, staging_path(spark, "landed"), split_above=BLOCKS_ABOVE, returns=delivery.return_files(files)
    )
    verdicts = csv.file_verdict(spark, out, records=landed, files=files)
    cells = csv.data_records(landed, verdicts).groupBy("file").agg(
        F.sum(F.col("cells")[0].cast("bigint")).alias("id_sum"), F.count_if(F.col("cells")[2] == "open").alias("open")
    )
    return verdicts.join(cells, "file", "left").select(
        exports.path_part("source").alias("source"),
        exports.path_part("year").cast("bigint").alias("year"),
        "bytes", "rows", "verdict", "id_sum", "open",
    )


def _kept_figures(spark: SparkSession, path: str) -> str:
    """Two deliveries of requests, the figures brought up to date after each; returns the folder of the state.

    The second delivery brings one source for the first time and another once more, with its later requests.
    """
    requests, log, kept = (staging_path(spark, n) for n in ("requests", "request-log", "figures"))
    everything = store.save_table(canonical.requests(spark, path, located=True), staging_path(spark, "all-requests"))
    source, created = F.col("source_id"), F.col("created_at")
    early = everything.where((source != "EUROPE") & ((source != AGAIN) | (created < F.lit(CHANGED))))
    for number, rows in ((1, early), (2, everything.where(source.isin(AGAIN, "EUROPE")))):
        store.write_delivery(rows, requests, log, number)
        state.refresh_state(
            spark, store.read_by_source(spark, requests), store.read_by_source(spark, log), kept
        )
    return kept


@query
def kpi_incremental(spark, path):
    """Monthly figures after the second delivery, of which only its own sources were counted."""
    held = state.read_state(spark, _kept_figures(spark, path))
    return kpi.kpis(state.state_kpis(held)).withColumns(queries.rounded("on_time_rate"))


@query
def kpi_state_sources(spark, path):
    """What the state holds of each source."""
    held = state.read_state(spark, _kept_figures(spark, path))
    return held.groupBy("source_id").agg(
        F.max("delivery").alias("delivery"),
        *[F.sum(m).alias(m) for m in ("received", "resolved", "on_time")],
    )


@query
def mapping_assigned(spark, path):
    """Columns of exports with headers of their own, by the best assignment of headers to fields."""
    out = staging_path(spark, "odd-exports")
    exports.write_odd(spark, path, out)
    records = csv.land_records(spark, out, staging_path(spark, "landed"))
    verdicts = csv.file_verdict(spark, out, records=records, files=delivery.discover(spark, out))
    verdicts = store.save_table(verdicts, staging_path(spark, "verdicts"))
    values = proposal.value_profile(csv.data_records(records, verdicts))
    chosen = proposal.assign_mapping(csv.header_cells(verdicts), values)
    return chosen.groupBy(exports.path_part("source").alias("source"), "field").agg(
        F.max("column_index").cast("bigint").alias("column_index"), F.count_distinct("column_index").alias("different")
    )


@query
def enriched_history(spark, path):
    """Requests by the names that held when they came, in both languages, with zone and source."""
    requests = canonical.requests(spark, path, located=True, closings=False)
    departments = dimensions.versions(values_table(spark, canonical.DEPARTMENTS, canonical.NAMES))
    categories = dimensions.versions(values_table(spark, canonical.CATEGORIES, canonical.NAMES))
    sources = canonical.table(spark, path, "region").select(F.col("r_name").alias("id"), F.lower("r_name").alias("filename"))
    full = dimensions.enrich_as_of(requests, departments, categories, canonical.locations(spark, path), sources)
    shown = dimensions.localized(full, "department", "sq", "department")
    shown = dimensions.localized(shown, "category", "en", "category")
    return shown.groupBy("department", "category", "location_zone", "source_filename").agg(
        F.count("*").alias("requests"), F.min("created_at").cast("date").alias("first_day")
    )


_FILES = "(SELECT source_id, id // 50000 AS shard FROM located GROUP BY 1, 2)"
_YEARS = """files AS (
  SELECT source_id AS source, year(created_at) AS year, count(*) AS rows,
    21 + sum(length(CAST(id AS VARCHAR) || department_id || status) + 3) AS bytes,
    CAST(sum(id) AS BIGINT) AS id_sum, count(*) FILTER (status = 'open') AS open FROM located GROUP BY 1, 2
)"""

_FAULTY = """CASE WHEN status = 'in_progress' THEN ['id type'] ELSE [] END
  || CASE WHEN id % 15 = 2 THEN ['created_at type'] ELSE [] END
  || CASE WHEN id % 10 = 1 THEN ['department missing'] ELSE [] END"""



def _history(name: str, rows: tuple) -> str:
    """A dimension whose versions hold until the next one of their id."""
    text = lambda v: "NULL" if v is None else f"'{v}'"
    listed = ", ".join(f"({text(i)}, {text(sq)}, {text(en)}, DATE '{since}')" for i, sq, en, since in rows)
    return f"""{name} AS (
  SELECT id, sq, en, a, coalesce(lead(a) OVER (PARTITION BY id ORDER BY a), DATE '9999-12-31') AS b
  FROM (VALUES {listed}) AS v(id, sq, en, a)
)"""


ORACLE = {
    "ingest_outcomes": oracle._with(oracle.LOCATED)
    + f"""SELECT kind, source_id, CASE WHEN faults = '' THEN 'canonical' ELSE 'faulty' END AS outcome, faults,
      count(*) AS rows, CAST(sum(CASE WHEN faults NOT LIKE 'id type%' THEN id END) AS BIGINT) AS id_sum,
      count(DISTINCT id // 50000) AS files, CASE source_id WHEN 'ASIA' THEN 2 ELSE 1 END AS delivery
    FROM (SELECT kind, source_id, id, CASE kind WHEN 'unmapped' THEN 'department unmapped'
        WHEN 'faulty' THEN array_to_string({_FAULTY}, ', ') ELSE '' END AS faults
      FROM located, (VALUES ('good'), ('blank'), ('unmapped'), ('faulty')) AS k(kind))
    GROUP BY ALL
    UNION ALL
    SELECT kind, source_id, 'refused', verdict, count(*), NULL, count(*), CASE source_id WHEN 'ASIA' THEN 2 ELSE 1 END
    FROM {_FILES}, (VALUES ('headers', 'headers'), ('ragged', 'format'), ('unclosed', 'format'), ('empty', 'empty'),
      ('text', 'type'), ('wide', 'size')) AS v(kind, verdict) GROUP BY ALL""",
    "released_rows": oracle._with(oracle.LOCATED)
    + """SELECT source_id, CASE WHEN status = 'in_progress' OR id % 15 = 2 THEN 'faulty' ELSE 'canonical' END AS outcome,
      id % 10 = 1 AS mended, count(*) AS rows FROM located GROUP BY 1, 2, 3""",
    "delivery_manifest": oracle._with(oracle.LOCATED, _YEARS)
    + f"""SELECT CASE WHEN year < 1998 THEN 1 ELSE 2 END AS delivery, source, count(*) AS files,
      CAST(sum(bytes) AS BIGINT) AS bytes, 0 AS empty, count(*) FILTER (rows <= {MOST_ROWS}) AS accepted,
      CAST(coalesce(sum(rows) FILTER (rows <= {MOST_ROWS}), 0) AS BIGINT) AS rows FROM files GROUP BY 1, 2
    UNION ALL SELECT 2, 'EMPTY', 1, 0, 1, 0, 0""",
    "strict_read": oracle._with(oracle.LOCATED)
    + """SELECT department_id AS department, status, count(*) AS requests, CAST(sum(id) AS BIGINT) AS id_sum,
      CAST(max(created_at) AS DATE) AS last_day, 0 AS bad FROM located WHERE source_id <> 'ASIA' GROUP BY 1, 2""",
    "return_exports": oracle._with(oracle.LOCATED, _YEARS)
    + "SELECT source, year, CAST(bytes AS BIGINT) AS bytes, rows, 'ok' AS verdict, id_sum, open FROM files",
    "kpi_incremental": oracle.ORACLE["kpi_monthly"],
    "kpi_state_sources": oracle._with(oracle.LOCATED)
    + """SELECT source_id, CASE WHEN source_id IN ('ASIA', 'EUROPE') THEN 2 ELSE 1 END AS delivery,
      count(*) FILTER (day(created_at) <= 24) AS received, count(*) FILTER (day(closed_at) <= 24) AS resolved,
      count(*) FILTER (day(closed_at) <= 24 AND closed_at <= deadline) AS on_time FROM located GROUP BY 1""",
    "mapping_assigned": "SELECT r_name AS source, field, column_index, 1 AS different FROM region JOIN (VALUES "
    + ", ".join(
        f"('{source}', '{field}', {columns.index(field) if field in columns else -1}::BIGINT)"
        for source, (_, columns) in exports.ODD_HEADERS.items()
        for field in proposal.FIELDS
    )
    + ") AS v(source, field, column_index) ON r_name = source",
    "enriched_history": oracle._with(oracle.LOCATED, _history("departments", canonical.DEPARTMENTS), _history("categories", canonical.CATEGORIES))
    + """SELECT coalesce(d.sq, d.en, department_id) AS department, coalesce(c.en, c.sq, category_id) AS category,
      source_id AS location_zone, lower(source_id) AS source_filename, count(*) AS requests,
      CAST(min(created_at) AS DATE) AS first_day
    FROM located
    LEFT JOIN departments d ON d.id = department_id AND created_at >= d.a AND created_at < d.b
    LEFT JOIN categories c ON c.id = category_id AND created_at >= c.a AND created_at < c.b GROUP BY 1, 2, 3, 4""",
}
