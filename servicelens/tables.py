"""Small tables made from values.

`VALUES` becomes a LocalRelation, so Spark knows its exact size and decides on a broadcast from
that size. A DataFrame made from a Python list has no size estimate and would shuffle both sides.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, Decimal)):
        return str(value)
    if isinstance(value, float):
        return f"double('{value!r}')"
    if isinstance(value, dt.datetime):
        return f"timestamp_ntz'{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"date'{value.isoformat()}'"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
    return f"'{text}'"


def values_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """`schema` is a DDL list without nested types, e.g. "department string, target double"."""
    columns = [(f.name, f.dataType.simpleString()) for f in T.StructType.fromDDL(schema).fields]
    listed = [tuple(row) for row in rows]
    names = ", ".join(f"`{name}`" for name, _ in columns)
    casts = ", ".join(f"CAST(`{name}` AS {kind}) AS `{name}`" for name, kind in columns)
    if not listed:
        nulls = ", ".join(f"CAST(NULL AS {kind}) AS `{name}`" for name, kind in columns)
        return spark.sql(f"SELECT {nulls} WHERE false")
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in listed)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({names})")
