"""Column profiles, personal-data flags and the golden-set comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What text reads as. A number would also cast to a date, as a year, so dates are written in full.
READS_AS = {
    "long": r"^[+-]?[0-9]{1,18}$",
    "double": r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$",
    "date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}",
}
# The same for columns that have a type already.
TYPED_AS = {
    "long": T.IntegralType,
    "double": T.NumericType,
    "date": (T.DateType, T.TimestampType, T.TimestampNTZType),
}

# What personal data looks like in a value, and in a header.
PII_VALUES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}",
    "phone": r"(^|[^A-Za-z0-9])(\+|00)?[0-9]{2,3}[ ./-]?[0-9]{2,3}[ ./-]?[0-9]{3,4}([^A-Za-z0-9]|$)",
    "id_number": r"(^|[^A-Za-z0-9])[A-Z][0-9]{8}[A-Z]([^A-Za-z0-9]|$)",
}
# Text without these cannot match the pattern of the kind; they are much cheaper to look for.
PII_HINTS = {
    "email": "@",
    "phone": r"[0-9]{2,3}[ ./-]?[0-9]{2,3}[ ./-]?[0-9]{3,4}",
    "id_number": r"[A-Z][0-9]{8}[A-Z]",
}
PII_HEADERS = {
    "name": r"(?i)(^|_)((first|last|full|middle|maiden|person|citizen|applicant|owner|contact)_?name|surname|emri|mbiemri)($|_)",
    "email": r"(?i)(^|_)e_?mail(_?(address|adresa))?($|_)",
    "phone": r"(?i)(^|_)(phone|tel|telefon|telefoni|mobile|cel|cell)(_?(phone|number|no|nr|numri))?($|_)",
    "id_number": r"(?i)(^|_)(nid|nipt|personal_?id|id_?number)($|_)",
}


def long_form(df: DataFrame, per_column: Mapping[str, Sequence[Column]]) -> DataFrame:
    """Aggregate each column's expressions in one pass and turn them into one row per column."""
    aggregates, rows = [], []
    for i, (name, expressions) in enumerate(per_column.items()):
        fields = [F.lit(name).alias("column")]
        for j, (alias, expression) in enumerate(expressions):
            aggregates.append(expression.alias(f"_{i}_{j}"))
            fields.append(F.col(f"_{i}_{j}").alias(alias))
        rows.append(F.struct(*fields))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    samples: int = 3,
    exact_distinct: bool = False,
) -> DataFrame:
    """One row per column: type, counts, distinct values, range, how often it reads as a type, samples.

    One pass without collecting values: distinct counts are sketches unless asked to be exact, and
    a sample is the value with the smallest md5, one per seed.
    """
    names = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}

    def fields(name: str):
        c = F.col(name)
        shown = c.cast("string")
        given = F.count(c)

        def reads_as(kind: str) -> Column:
            if not isinstance(types[name], T.StringType):
                fits = F.lit(isinstance(types[name], TYPED_AS[kind]))
            elif kind == "date":
                fits = F.when(c.rlike(READS_AS[kind]), F.substring(c, 1, 10).try_cast("date").isNotNull())
            else:
                fits = c.rlike(READS_AS[kind])
            return F.try_divide(F.count_if(c.isNotNull() & fits).cast("double"), given.cast("double"))

        yield "type", F.any_value(F.lit(types[name].simpleString()))
        yield "rows", F.count("*")
        yield "nulls", F.count_if(c.isNull())
        yield "null_pct", 100.0 * F.try_divide(
            F.count_if(c.isNull()).cast("double"), F.count("*").cast("double")
        )
        yield "distinct_values", F.approx_count_distinct(c)
        yield "min_value", F.min(c).cast("string")
        yield "max_value", F.max(c).cast("string")
        for kind in READS_AS:
            yield f"reads_as_{kind}", reads_as(kind)
        yield "samples", F.array_distinct(
            F.array(*[F.min_by(shown, F.md5(F.concat(F.lit(str(i)), shown))) for i in range(samples)])
        )

    found = long_form(df, {name: list(fields(name)) for name in names})
    if not exact_distinct:
        return found
    exact = distinct_counts(df, names)
    counted = F.coalesce("_exact", F.lit(0).cast("long")).alias("distinct_values")
    shown = [counted if c == "distinct_values" else found[c] for c in found.columns]
    return found.join(exact.withColumnRenamed("distinct_values", "_exact"), "column", "left").select(*shown)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, distinct_values): exact numbers of different values, of columns with any.

    Columns become rows of (column, value) that are grouped once, so each task first leaves out what it has seen,
    and a value that much of a column shares is one row a task. Values are compared as text.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def shown(name: str) -> Column:
        c = F.col(name)
        if isinstance(kinds[name], T.FractionalType):
            c = c + F.lit(0).cast(kinds[name])  # 0 and -0 are one value
        return F.hex(c) if isinstance(kinds[name], T.BinaryType) else c.cast("string")

    entry = [F.struct(F.lit(c).alias("column"), shown(c).alias("value")) for c in columns]
    values = df.select(F.inline(F.array(*entry))).where(F.col("value").isNotNull())
    return values.distinct().groupBy("column").agg(F.count("*").alias("distinct_values"))


def pii_profile(df: DataFrame, min_rate: float = 0.05, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, kind, rate, by_header, flagged): share of given values that look like personal data.

    A column is flagged by its values or by its header; names, and columns other than text, only by the header.
    """
    import re

    types = {f.name: f.dataType for f in df.schema.fields}
    names = list(columns or [f.name for f in df.schema.fields])

    def fields(name: str):
        shown = F.col(name)
        for kind, pattern in PII_VALUES.items():
            if not isinstance(types[name], T.StringType):
                # a number has neither a prefix nor separators; a million keys are no phone numbers
                yield kind, F.coalesce(F.any_value(F.lit(0.0)), F.lit(0.0))
                continue
            hint = PII_HINTS[kind]
            found = (shown.contains(hint) if hint == "@" else shown.rlike(hint)) & shown.rlike(pattern)
            yield kind, F.coalesce(F.avg(found.cast("double")), F.lit(0.0))

    wide = long_form(df, {name: list(fields(name)) for name in names})
    by_header = {
        kind: [n for n in names if re.search(pattern, n)] for kind, pattern in PII_HEADERS.items()
    }
    rows = []
    for kind in PII_HEADERS:
        rate = F.col(kind) if kind in PII_VALUES else F.lit(0.0)
        header = F.col("column").isin(*by_header[kind]) if by_header[kind] else F.lit(False)
        rows.append(
            F.struct(
                F.lit(kind).alias("kind"),
                rate.alias("rate"),
                header.alias("by_header"),
                (header | (rate >= min_rate)).alias("flagged"),
            )
        )
    return wide.select("column", F.inline(F.array(*rows)))


def drop_pii(df: DataFrame, pii: DataFrame) -> DataFrame:
    """`df` without its flagged columns; reads the profile, which has a few rows per column."""
    flagged = [r["column"] for r in pii.where("flagged").select("column").distinct().collect()]
    return df.drop(*flagged)


def golden_accuracy(
    expected: DataFrame, actual: DataFrame, key: str = "question_id", value: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """(key, expected, actual, ok) and one row with `questions, correct, accuracy`.

    Questions on one side only count as wrong; two NULLs agree.
    """
    left = expected.select(key, F.col(value).alias("expected"), F.lit(True).alias("_in_expected"))
    right = actual.select(key, F.col(value).alias("actual"), F.lit(True).alias("_in_actual"))
    both = F.col("_in_expected").isNotNull() & F.col("_in_actual").isNotNull()
    compared = (
        left.join(right, key, "full_outer")
        .withColumn("ok", both & F.col("expected").eqNullSafe(F.col("actual")))
        .drop("_in_expected", "_in_actual")
    )
    score = compared.agg(
        F.count("*").alias("questions"),
        F.count_if("ok").alias("correct"),
        F.avg(F.col("ok").cast("double")).alias("accuracy"),
    )
    return compared, score
