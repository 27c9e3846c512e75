"""Month windows that cover the same first days of every month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

DEFAULT_DAYS = 24


def month_of(ts: Column | str) -> Column:
    return F.trunc(col(ts).cast("date"), "month")


def in_window(ts: Column | str, n_days: int = DEFAULT_DAYS) -> Column:
    return F.dayofmonth(col(ts)) <= n_days


def effective_month(ts: Column | str, n_days: int = DEFAULT_DAYS) -> Column:
    """The first month whose window ends after `ts`."""
    start = month_of(ts)
    return F.when(in_window(ts, n_days), start).otherwise(F.add_months(start, 1))
