"""Named reports over the order, event, document and conversation tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.calendar import DEFAULT_DAYS
from ..operators import ask, briefing, kpi, labels, mapping, quality, scorecard, signals, usage
from ..operators import requests as rq
from ..session import staging_path
from ..sources import delivery
from ..sources import exports as csv
from ..sources import inventory as inv
from ..sources import store
from ..tables import values_table
from . import canonical, exports

WEIGHTS = (
    ("AUTOMOBILE", 0.39),
    ("BUILDING", 0.25),
    ("FURNITURE", 0.21),
    ("HOUSEHOLD", 0.1),
    ("MACHINERY", None),
)
TARGETS = (
    ("BUILDING", "on_time_rate", dt.date(1999, 6, 1), 60.0),
    ("MACHINERY", "on_time_rate", dt.date(2000, 1, 1), 40.0),
)
# The month that every one-month question asks about.
ASKED = dt.date(2000, 9, 1)
BUDGET = 2.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(*names: str) -> dict[str, Column]:
    return {n: F.round(n, 6) for n in names}


def _metrics(spark: SparkSession, path: str) -> DataFrame:
    return rq.request_kpis(canonical.requests(spark, path))


def _kpi(spark: SparkSession, path: str) -> DataFrame:
    return kpi.kpis(_metrics(spark, path))


def _inventory(spark: SparkSession, path: str) -> DataFrame:
    """What each source delivered for a month: requests of its first days, up to the last of them."""
    located = kpi.clip_month(canonical.requests(spark, path, located=True, closings=False), "created_at")
    name = F.concat(F.lower(F.translate("source_id", " ", "_")), F.lit(".csv"))
    return inv.source_inventory(located, "created_at", filename=name, period=F.trunc("created_at", "month"))


def _stale_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Behind are sources without anything from the last days before a month's window ends."""
    return inv.stale_sources(_inventory(spark, path), F.date_add("period", DEFAULT_DAYS - 1))


def _card(spark: SparkSession, path: str, rank: bool = False) -> DataFrame:
    targets = values_table(
        spark, TARGETS, "department_id string, metric string, period date, target double"
    )
    return scorecard.scorecard(_kpi(spark, path), targets, default=50.0, rank=rank)


@query
def kpi_monthly(spark, path):
    return _kpi(spark, path).withColumns(rounded("on_time_rate"))


@query
def metric_view(spark, path):
    """KPIs read through the allow-list, all of them."""
    _kpi(spark, path).createOrReplaceTempView("kpi_by_month")
    return store.read_view(
        spark, "kpi_by_month", ["kpi_by_month"], ["period", "department", "received", "overdue"], limit=None
    )


@query
def exported_metrics(spark, path):
    """KPIs written as JSON for another system, read back."""
    out = staging_path(spark, "metrics")
    store.export_metrics(_metrics(spark, path), out, "json")
    counts = "received bigint, resolved bigint, on_time bigint, overdue bigint"
    return spark.read.schema(f"period date, department string, {counts}").json(out)


@query
def kpi_one_department(spark, path):
    """One department up to a month: the department is cut from the requests, the month from the result."""
    chosen = kpi.by_department(canonical.requests(spark, path), "BUILDING", "department_id")
    monthly = kpi.by_period(rq.request_kpis(chosen), dt.date(1998, 12, 1), cumulative=True)
    return kpi.kpis(monthly, total=False).withColumns(rounded("on_time_rate"))


@query
def kpi_growth(spark, path):
    return kpi.growth(_kpi(spark, path)).withColumns(
        rounded("on_time_rate", "received_growth", "rate_change")
    )


@query
def overdue_snapshot(spark, path):
    return rq.overdue_snapshot(canonical.requests(spark, path))


@query
def overdue_share_top1(spark, path):
    shares = kpi.share(_metrics(spark, path)).withColumns(rounded("overdue_share"))
    return kpi.top_overdue(shares).select("period", "department", "overdue", "overdue_share")


@query
def most_overdue_department(spark, path):
    return kpi.q_overdue(_metrics(spark, path), ASKED)


@query
def on_time_performance(spark, path):
    counts = rq.month_counts(canonical.requests(spark, path), ASKED, measures=["resolved", "on_time"])
    return kpi.q_performance(counts).withColumns(rounded("on_time_percent"))


@query
def request_volume(spark, path):
    """One month's requests, read by date and without the order lines."""
    plain = canonical.requests(spark, path, closings=False)
    return kpi.q_volume(rq.month_counts(plain, ASKED, measures=["received"]))


@query
def latest_kpi(spark, path):
    return kpi.latest(_kpi(spark, path)).withColumns(rounded("on_time_rate"))


@query
def scorecard_ranked(spark, path):
    card = _card(spark, path, rank=True).withColumns(rounded("on_time_rate"))
    return card.withColumn("place", F.col("place").cast("long"))


@query
def department_status(spark, path):
    return scorecard.department_status(_card(spark, path), _stale_inventory(spark, path)).select(
        "period", "department", F.round("on_time_rate", 6).alias("on_time_rate"), "status", "severity"
    )


@query
def attention(spark, path):
    return scorecard.attention(_card(spark, path), _stale_inventory(spark, path))


@query
def attention_count(spark, path):
    items = scorecard.attention(_card(spark, path), _stale_inventory(spark, path))
    return scorecard.attention_count(items)


@query
def attention_text(spark, path):
    items = scorecard.attention(_card(spark, path), _stale_inventory(spark, path))
    return scorecard.attention_text(items, "sq").select("period", "department", "title", "description")


@query
def reconcile(spark, path):
    return kpi.reconcile(_kpi(spark, path)).agg(F.count("*").alias("mismatches"))


@query
def allocate_remainder(spark, path):
    monthly = (
        canonical.table(spark, path, "orders")
        .groupBy(F.trunc("o_orderdate", "month").alias("period"))
        .agg(F.count("*").alias("received"), F.count_if(F.col("o_orderstatus") == "F").alias("resolved"))
    )
    return kpi.allocate(monthly, ["received", "resolved"], WEIGHTS)


def _trend(spark, path, department):
    """City totals before 1998, then measured months; both count the same days and closings."""
    metrics = _metrics(spark, path)
    begin = F.lit(dt.date(1998, 1, 1))
    history = (
        metrics.where(F.col("period") < begin)
        .groupBy("period")
        .agg(F.sum("received").alias("received"), F.sum("resolved").alias("resolved"))
    )
    measured = metrics.where(F.col("period") >= begin)
    return kpi.trend(history, measured, department, dt.date(2000, 12, 1), WEIGHTS)


@query
def trend_union(spark, path):
    return _trend(spark, path, "BUILDING")


@query
def chart_series(spark, path):
    return kpi.chart_series(_trend(spark, path, kpi.ALL))


@query
def source_inventory(spark, path):
    return _inventory(spark, path)


@query
def source_count(spark, path):
    return inv.source_count(_inventory(spark, path))


@query
def stale_sources(spark, path):
    return inv.sources_for(_stale_inventory(spark, path), "BUILDING")


@query
def enriched_by_zone(spark, path):
    """Requests with resolved location and source, counted by what was resolved."""
    located = canonical.requests(spark, path, located=True, closings=False)
    places = canonical.locations(spark, path)
    sources = canonical.table(spark, path, "region").select(
        F.col("r_name").alias("id"), F.lower("r_name").alias("filename")
    )
    enriched = rq.enrich_requests(located, locations=places, sources=sources)
    return rq.slice_requests(enriched, ["location_zone", "source_filename", "category_id"])


@query
def orphan_requests(spark, path):
    """Requests whose location is missing from a list that lacks one zone."""
    located = canonical.requests(spark, path, located=True, closings=False)
    known = canonical.locations(spark, path).where(F.col("zone") != "AFRICA")
    return rq.slice_requests(rq.orphans(located, known, "location_id"), ["location_id"])


@query
def by_zone(spark, path):
    located = canonical.requests(spark, path, located=True, closings=False)
    places = canonical.locations(spark, path)
    at = F.substring_index("id", "_", -1).cast("double")
    return rq.by_zone(located, places.withColumn("lat", at).withColumn("lon", -at)).withColumns(
        rounded("lat", "lon")
    )


@query
def slice_status(spark, path):
    plain = canonical.requests(spark, path, closings=False)
    return rq.slice_requests(plain, ["status", "category_id", "department_id"])


@query
def budget_variance(spark, path):
    """Every order is a budget line: its price against a flat plan."""
    orders = canonical.table(spark, path, "orders")
    departments = canonical.customers(spark, path)
    lines = orders.join(departments, F.col("o_custkey") == F.col("c_custkey")).select(
        "department_id",
        F.trunc("o_orderdate", "month").alias("period"),
        F.lit(250000).cast("decimal(18,2)").alias("planned"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("actual"),
    )
    out = rq.budget_variance(lines, kpi.kpis(_metrics(spark, path), total=False))
    money = {c: F.col(c).cast("decimal(28,2)") for c in ("planned", "actual", "variance")}
    # Ten places: a share of a round plan can end in a five at the seventh.
    return out.withColumns({**money, "variance_pct": F.round("variance_pct", 10), **rounded("on_time_rate")})


def _daily(spark, path):
    return signals.daily_series(canonical.table(spark, path, "events"), "ts", ["event_type"])


@query
def signals_daily(spark, path):
    return signals.signals(_daily(spark, path), ["event_type"], threshold=2.0).withColumns(
        rounded("baseline", "spread", "deviation", "z_score")
    )


@query
def signals_monthly(spark, path):
    """Anomalies of the monthly on-time rate."""
    out = signals.signals(_kpi(spark, path), ["department"], "period", "on_time_rate", 7, 3.0)
    return out.select(
        "period",
        "department",
        *[F.round(c, 6).alias(c) for c in ("on_time_rate", "baseline", "z_score")],
        "is_anomaly",
    )


@query
def trend_slope(spark, path):
    return signals.trend_slope(_daily(spark, path), ["event_type"]).withColumns(rounded("slope"))


@query
def profile_events(spark, path):
    """Profile of the event columns, less the sketched and sampled values that have no SQL form."""
    out = quality.profile(canonical.table(spark, path, "events"))
    return out.drop("samples", "distinct_values").withColumns(
        rounded("null_pct", "reads_as_long", "reads_as_double", "reads_as_date")
    )


@query
def profile_samples(spark, path):
    """Exact distinct counts and sample values."""
    out = quality.profile(canonical.table(spark, path, "events"), exact_distinct=True)
    return out.select("column", "distinct_values", F.array_join("samples", " | ").alias("samples"))


@query
def pii_profile_docs(spark, path):
    docs = canonical.table(spark, path, "documents").withColumnRenamed("source", "source_name")
    return quality.pii_profile(docs).withColumns(rounded("rate"))


@query
def shared_columns(spark, path):
    """Profile of the columns left after the personal ones are dropped."""
    docs = canonical.table(spark, path, "documents")
    safe = quality.drop_pii(docs, quality.pii_profile(docs, min_rate=0.01))
    return quality.profile(safe).select("column", "type", "rows", "nulls")


RAW_TYPES = {"event": "bigint", "at": "timestamp_ntz", "kind": "bigint", "amount": "double", "k": "int"}


def _raw_events(spark, path):
    return canonical.table(spark, path, "events").select(
        F.concat(F.when(F.col("event_id") % 101 == 7, "E-").otherwise(" "), F.col("event_id").cast("string")).alias("event"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("on "), F.col("ts").cast("string")))
        .otherwise(F.col("ts").cast("string")).alias("at"),
        F.col("event_type").alias("kind"),
        F.concat(F.when(F.col("user_id") % 50 == 3, "~").otherwise(""), F.col("value").cast("string")).alias("amount"),
        F.when(F.col("event_id") % 13 == 5, "none").otherwise(
            F.concat(F.lit("\t"), F.get_json_object("props", "$.k"), F.lit("\u00a0"))
        ).alias("k"),
    )


@query
def coerce_errors(spark, path):
    return mapping.coerce(_raw_events(spark, path), RAW_TYPES)[1]


@query
def coerced_events(spark, path):
    typed, _ = mapping.coerce(_raw_events(spark, path), RAW_TYPES)
    return typed.groupBy(F.col("at").cast("date").alias("day")).agg(
        F.count("*").alias("n"), F.count("kind").alias("kinds"), F.sum("k").alias("k")
    )


@query
def decoded_props(spark, path):
    """JSON maps of the events, counted by one of their values."""
    decoded = mapping.decode_mapping(canonical.table(spark, path, "events"), "props")
    return decoded.groupBy(F.col("mapping")["k"].alias("k")).agg(F.count("*").alias("events"))


@query
def missing_fields(spark, path):
    """Required fields of closed requests; some were closed without a closing time."""
    closed = canonical.requests(spark, path).where(F.col("status") == "closed")
    return mapping.require_fields(closed, ["id", "department_id", "created_at", "closed_at"])[2]


def _asked(spark, path):
    """What users wrote, and every fixed question once per conversation, loudly."""
    turns = canonical.table(spark, path, "conversations")
    written = turns.where(F.col("role") == "user").select(F.lit("en").alias("locale"), "text")
    loud = F.array(
        *[
            F.struct(
                F.lit(locale).alias("locale"),
                F.lit(f"  {labels.TEXT[key][i].upper()}!?.\n").alias("text"),
            )
            for key in ask.QUESTIONS.values()
            for i, locale in enumerate(labels.LOCALES)
        ],
        F.struct(F.lit("en").alias("locale"), F.lit(" \t ").alias("text")),
    )
    repeated = turns.where(F.col("turn") == 0).select(F.inline(loud))
    return written.unionByName(repeated)


@query
def ask_match(spark, path):
    matched = ask.match_questions(_asked(spark, path), ask.question_catalog(spark))
    return matched.groupBy("locale", "key", "outcome").agg(F.count("*").alias("asked"))


@query
def ask_answers(spark, path):
    return ask.answers(briefing.briefing_facts(_kpi(spark, path)), "en")


def _gated(spark, path):
    return usage.budget_gate(
        canonical.usage(spark, path), usage.price_table(spark), BUDGET, order=("conv_id", "turn")
    )


@query
def usage_spend(spark, path):
    """What the calls cost that the budget let through."""
    return usage.spend(_gated(spark, path), usage.price_table(spark)).withColumns(rounded("cost_usd"))


@query
def budget_gate(spark, path):
    return _gated(spark, path).select(
        "conv_id", "turn", "model", F.round("cost_usd", 8).alias("cost_usd"),
        F.round("spent_before", 8).alias("spent_before"), "allowed",
    )


@query
def call_outcomes(spark, path):
    """Outcomes of all calls; there is no service for every seventh conversation."""
    gated = _gated(spark, path)
    available = F.col("conv_id") % 7 != 3
    code = usage.call_outcome(available, F.col("allowed"), F.col("failure"), F.col("refusal"))
    return gated.groupBy(F.coalesce(code, F.lit("ok")).alias("outcome")).agg(F.count("*").alias("calls"))


def _facts(spark, path):
    return briefing.briefing_facts(kpi.growth(_kpi(spark, path)))


@query
def briefing_facts(spark, path):
    """With the stale sources and the anomalies of each month."""
    monthly = kpi.growth(_kpi(spark, path))
    unusual = signals.signals(monthly, ["department"], "period", "on_time_rate", 7, 3.0)
    facts = briefing.briefing_facts(unusual, _stale_inventory(spark, path))
    return facts.withColumns(rounded("on_time_rate", "rate_change"))


@query
def briefing_lines(spark, path):
    return briefing.briefing_lines(_facts(spark, path), _stale_inventory(spark, path), title="Services")


@query
def briefing_files(spark, path):
    """The written reports, one text per period and locale."""
    out = staging_path(spark, "briefing")
    store.write_briefing(briefing_lines(spark, path), out)
    files = spark.read.schema("text string, period date, locale string")
    return files.text(out, wholetext=True).select("period", "locale", "text")


@query
def localized_status(spark, path):
    """Counted by status first; three rows then look for their labels."""
    orders = canonical.table(spark, path, "orders").select(canonical.status().alias("status"))
    counted = rq.slice_requests(orders, ["status"])
    key = F.when(F.col("status") == "open", "received").when(F.col("status") == "closed", "resolved")
    shown = labels.localize(counted, labels.label_table(spark), F.coalesce(key, "status"), "sq")
    return shown.groupBy("label").agg(F.sum("requests").alias("requests"))


@query
def display_text(spark, path):
    """Figures and dates of every KPI row as shown in both languages."""
    changes = kpi.growth(_kpi(spark, path))
    shown = []
    for locale in labels.LOCALES:
        shown += [
            tx.format_decimal(F.col("overdue") * 1000, locale).alias(f"overdue_{locale}"),
            tx.format_decimal("on_time_rate", locale, 1).alias(f"rate_{locale}"),
            tx.label_empty(tx.signed("received_growth", locale), labels.text("emptyValue", locale)).alias(
                f"growth_{locale}"
            ),
            tx.period_label("period", locale).alias(f"label_{locale}"),
            tx.source_date("period", locale).alias(f"date_{locale}"),
        ]
    return changes.select("period", "department", *shown)


def _landed(spark: SparkSession, path: str, broken: bool, kinds: tuple[str, ...] = ()):
    """The landed records of written exports and the table of their verdicts; `kinds` are those a query asks about."""
    out = exports.kept_exports(spark, path, kinds if broken else ("good",))
    limits = csv.FileLimits(max_columns=exports.MOST_COLUMNS) if broken else csv.FileLimits()
    records = csv.land_records(spark, out, staging_path(spark, "landed"), limits)
    files = store.save_table(delivery.discover(spark, out), staging_path(spark, "files"))
    verdicts = csv.file_verdict(spark, out, limits, records=records, files=files)
    return records, store.save_table(verdicts, staging_path(spark, "verdicts"))


def _verdicts(spark: SparkSession, path: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The table of the verdicts of written exports, without their records."""
    out = exports.kept_exports(spark, path, kinds)
    files = store.save_table(delivery.discover(spark, out), staging_path(spark, "files"))
    verdicts = csv.file_verdict(spark, out, csv.FileLimits(max_columns=exports.MOST_COLUMNS), files=files)
    return store.save_table(verdicts, staging_path(spark, "verdicts"))


@query
def ingest_verdict(spark, path):
    verdicts = _verdicts(spark, path)
    rows = F.when(F.col("verdict") == "ok", F.col("rows"))
    return verdicts.groupBy(exports.path_part("kind").alias("kind"), "verdict").agg(
        F.count("*").alias("files"), F.sum(rows).alias("rows")
    )


def _mapped(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    patterns = (*mapping.PATTERNS, ("created_at", "^created_at$"), ("note", "^note$"))
    headers = csv.header_cells(verdicts)
    proposed = mapping.propose_mapping(headers, patterns)
    valid = mapping.validate_mapping(proposed, headers).where("valid").select("file")
    fields = [field for field, _ in patterns]
    return mapping.apply_file_mapping(
        rows, proposed.join(valid, "file", "left_semi"), fields
    )


@query
def ingest_canonical(spark, path):
    """Exports to canonical rows: checked, mapped, typed, written by source and read back."""
    # files with blank lines hold the same requests once more
    records, verdicts = _landed(spark, path, broken=True, kinds=("good",))
    mapped = _mapped(csv.data_records(records, verdicts), verdicts)
    typed, _ = mapping.coerce(mapped, {"id": "bigint", "created_at": "date"})
    rows = typed.select("id", "department", "status", "created_at", "note", exports.path_part("source").alias("source_id"))
    out = staging_path(spark, "canonical")
    store.write_canonical(rows, out)
    return (
        spark.read.parquet(out)
        .groupBy("source_id", "department", "status")
        .agg(
            F.count("*").alias("requests"),
            F.sum("id").alias("id_sum"),
            F.min("created_at").alias("first_day"),
            F.max(F.length("note")).cast("long").alias("longest_note"),
        )
    )


@query
def ingest_errors(spark, path):
    """Values of the exports that do not fit their type or are missing, by source."""
    records, verdicts = _landed(spark, path, broken=True, kinds=("faulty",))
    mapped = _mapped(csv.data_records(records, verdicts), verdicts)
    # sound rows have no fault to count; a filter for them would repeat the whole check as its condition
    marked = mapping.with_faults(mapped, {"id": "bigint", "created_at": "date"}, ["id", "department", "status"])
    by_file = mapping.fault_counts(marked, ["file"])
    return by_file.groupBy(exports.path_part("source").alias("source"), "field", "problem").agg(F.sum("rows").alias("rows"))


def _sources(verdicts: DataFrame) -> DataFrame:
    """One saved mapping per source, from its good exports: (source, mapping_json, files)."""
    good = verdicts.where(exports.path_part("kind") == "good")
    headers = csv.header_cells(good)
    saved = mapping.mapping_json(mapping.propose_mapping(headers), headers)
    by_source = saved.groupBy(exports.path_part("source").alias("source"))
    return by_source.agg(F.min("mapping_json").alias("mapping_json"), F.count("*").alias("files"))


@query
def source_lineage(spark, path):
    """What is kept of each source: its mapping, and how many files came with it."""
    verdicts = _verdicts(spark, path, ("good",))
    return _sources(verdicts)


@query
def reused_mapping(spark, path):
    """Saved mappings put on the next upload of each source; headers in another language do not fit."""
    verdicts = _verdicts(spark, path, ("good", "faulty"))
    lineage = store.save_table(_sources(verdicts), staging_path(spark, "lineage"))
    upload = csv.header_cells(verdicts.where(exports.path_part("kind") == "faulty"))
    headers = upload.withColumn("source", exports.path_part("source"))
    chosen = mapping.saved_mapping(lineage, headers, mapping.propose_mapping(upload))
    return chosen.groupBy(exports.path_part("source").alias("source"), "field", "origin").agg(
        F.max("column_index").cast("long").alias("column_index"), F.count("*").alias("files")
    )


@query
def import_preview(spark, path):
    records, verdicts = _landed(spark, path, broken=False)
    first = _mapped(csv.preview(records, verdicts, 5), verdicts)
    return first.select(
        exports.path_part("source").alias("source"),
        exports.path_part("shard").cast("long").alias("shard"),
        F.col("row_no").cast("long").alias("row_no"),
        "id",
        tx.label_empty("department", labels.text("emptyValue", "en")).alias("department"),
        "status",
        "note",
    )


@query
def mapping_proposal(spark, path):
    """Proposals for all accepted files; those of kind `unmapped` have no department."""
    verdicts = _verdicts(spark, path)
    headers = csv.header_cells(verdicts)
    proposed = mapping.propose_mapping(headers)
    return (
        proposed.join(mapping.validate_mapping(proposed, headers), "file")
        .select(
            exports.path_part("kind").alias("kind"),
            exports.path_part("source").alias("source"),
            "field",
            F.col("column_index").cast("long").alias("column_index"),
            "valid",
        )
        .distinct()
    )


@query
def golden_accuracy(spark, path):
    """KPI table against independent counts of received and resolved requests per department and month."""
    requests = canonical.requests(spark, path)
    question = F.concat_ws("/", "department", F.col("period").cast("string"), "measure")

    def counted(at: str, measure: str) -> DataFrame:
        rows = kpi.clip_month(requests, at).groupBy(
            F.col("department_id").alias("department"), F.trunc(at, "month").alias("period")
        )
        return rows.agg(F.count("*").alias("value")).withColumn("measure", F.lit(measure))

    expected = counted("created_at", "received").unionByName(counted("closed_at", "resolved"))
    actual = kpi.kpis(_metrics(spark, path)).unpivot(
        ["department", "period"], ["received", "resolved"], "measure", "value"
    )
    expected, actual = (f.select(question.alias("question_id"), "value") for f in (expected, actual))
    return quality.golden_accuracy(expected, actual)[1].withColumns(rounded("accuracy"))
