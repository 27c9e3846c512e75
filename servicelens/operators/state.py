"""Monthly figures kept as changes by source, so that a delivery costs only its own sources.

The figures of a month are sums over requests: received, resolved, on time, and how many became or ceased to be
overdue. The state is a table of these sums by source, department and month, partitioned by source. A source that
is delivered for the first time or again is counted anew from its own partition of the requests, and its rows of
the state are replaced; the others are not read. Figures over all sources are sums of the state, which has a
row per source, department and month however many requests there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import DEFAULT_DAYS
from ..tables import values_table
from .requests import CHANGES, active_month, monthly_changes, monthly_levels

STATE = (
    "department string, period date, received bigint, resolved bigint, on_time bigint, overdue_change bigint, "
    "delivery bigint, source_id string"
)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The state; empty where none was written yet. A source without requests has one row without a month."""
    try:
        return spark.read.schema(STATE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return values_table(spark, [], STATE)


def _fields() -> list[list[str]]:
    return [field.split() for field in STATE.split(", ")]


def pending_sources(log: DataFrame, state: DataFrame) -> DataFrame:
    """(source_id, delivery): sources whose latest delivery the state does not hold. No request is read."""
    latest = log.groupBy("source_id").agg(F.max("delivery").cast("bigint").alias("delivery"))
    held = state.groupBy("source_id").agg(F.max("delivery").alias("_held"))
    return (
        latest.join(held, latest["source_id"].eqNullSafe(held["source_id"]), "left")
        .where(F.col("_held").isNull() | (F.col("_held") < F.col("delivery")))
        .select(latest["source_id"], "delivery")
    )


def delivered_requests(requests: DataFrame, sources: Sequence[str | None]) -> DataFrame:
    """The requests of some sources. They are named one by one, so that the scan opens their partitions only."""
    named = [s for s in sources if s is not None]
    wanted = F.col("source_id").isin(*named) if named else F.lit(False)
    return requests.where(wanted | F.col("source_id").isNull() if None in sources else wanted)


def source_state(requests: DataFrame, pending: DataFrame, n_days: int = DEFAULT_DAYS) -> DataFrame:
    """What the state holds of pending sources: their changes, and a row without a month for each.

    That row takes the place of the figures of a source that no longer has requests, and says which delivery
    the state has seen.
    """
    changes = monthly_changes(requests, n_days, ["source_id"])
    marks = pending.select(
        *[F.lit(None if name in ("department", "period") else 0).cast(kind).alias(name) for name, kind in _fields()[:-2]],
        "delivery",
        "source_id",
    )
    same = changes["source_id"].eqNullSafe(pending["source_id"])
    numbered = changes.join(pending, same).select(changes["*"], pending["delivery"])
    names = [name for name, _ in _fields()]
    return numbered.select(*names).unionByName(marks)


def refresh_state(
    spark: SparkSession, requests: DataFrame, log: DataFrame, path: str, n_days: int = DEFAULT_DAYS
) -> list[str | None]:
    """Bring the state in `path` up to the deliveries of the `log`; returns the sources that were counted.

    `requests` is the stored table, partitioned by source. Only the names of pending sources come to the
    driver, as many as there are partitions to open. A refresh that broke off leaves sources pending and
    replaces whole sources when it runs again, so nothing counts twice.
    """
    pending = pending_sources(log, read_state(spark, path)).collect()
    if not pending:
        return []
    sources = [r["source_id"] for r in pending]
    listed = values_table(spark, pending, "source_id string, delivery bigint")
    (
        source_state(delivered_requests(requests, sources), listed, n_days)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source_id")
        .parquet(path)
    )
    return sources


def state_changes(state: DataFrame) -> DataFrame:
    """(department, period, CHANGES) over all sources."""
    counted = state.where(F.col("period").isNotNull())
    return counted.groupBy("department", "period").agg(*[F.sum(c).alias(c) for c in CHANGES])


def state_kpis(state: DataFrame) -> DataFrame:
    """(period, department, received, resolved, on_time, overdue), equal to `request_kpis` of all requests.

    The first and last month are one row that a scalar subquery takes from the state.
    """
    changes = state_changes(state)
    first, last = (changes.agg(f(active_month())).scalar() for f in (F.min, F.max))
    return monthly_levels(changes, first, last)
