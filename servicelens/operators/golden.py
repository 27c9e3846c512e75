"""Golden set: expected answers as result sets, compared with actual ones without regard to the order of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers agree if they differ by at most this share of the expected one, or by this much near 0.
TOLERANCE = 1e-6
#: Places that fingerprints keep of a number.
DIGITS = 6


def _measures(df: DataFrame, by: Sequence[str]) -> tuple[list[str], list[str]]:
    """The number columns, and the others, of an answer."""
    rest = [f for f in df.schema.fields if f.name not in by]
    numbers = [f.name for f in rest if isinstance(f.dataType, T.NumericType)]
    return numbers, [f.name for f in rest if f.name not in numbers]


def fingerprints(answers: DataFrame, by: Sequence[str], digits: int = DIGITS) -> DataFrame:
    """(by, rows, fingerprint): equal for equal sets of rows in any order, repeated rows included.

    The fingerprint adds up two hashes of each row, so it is made where the rows are and needs no sorting. Numbers
    count by their first `digits` places.
    """
    numbers, others = _measures(answers, by)
    # adding 0 makes -0 and 0 one value
    values = [F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in sorted(numbers)]
    values += [F.col(c).cast("string") for c in sorted(others)]
    nulls = [v.isNull() for v in values]
    hashes = [F.xxhash64(F.lit(seed), *values, *nulls).cast("decimal(20,0)") for seed in (0, 1)]
    return answers.groupBy(*by).agg(
        F.count("*").alias("rows"), F.struct(*[F.sum(h).alias(f"h{i}") for i, h in enumerate(hashes)]).alias("fingerprint")
    )


def _close(a: Column, b: Column, tolerance: float) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(b)), F.lit(False))


def compare_answers(
    expected: DataFrame, actual: DataFrame, by: Sequence[str], tolerance: float = TOLERANCE
) -> DataFrame:
    """(by, expected_rows, actual_rows, verdict) of every answer on either side.

    `equal` has the same fingerprint; `within` has as many rows, which agree one by one but for the tolerance;
    others are `wrong`, or `missing` or `unexpected` where one side has none. Only answers of different fingerprints
    are compared by row: rows meet on everything that is no number, in the order of their numbers.
    """
    sides = {"expected": expected, "actual": actual.select(*expected.columns)}
    prints = {s: fingerprints(df, by).withColumnsRenamed({"rows": f"{s}_rows", "fingerprint": f"_{s}"}) for s, df in sides.items()}
    met = prints["expected"].join(prints["actual"], list(by), "full_outer")
    alike = F.col("expected_rows").eqNullSafe(F.col("actual_rows"))
    met = met.withColumn(
        "verdict",
        F.when(F.col("_expected").isNull(), "unexpected")
        .when(F.col("_actual").isNull(), "missing")
        .when(alike & (F.col("_expected") == F.col("_actual")), "equal")
        .when(~alike, "wrong"),
    ).drop("_expected", "_actual")

    numbers, others = _measures(expected, by)
    keys = [*by, *others]
    open_ = met.where(F.col("verdict").isNull()).select(*by)
    order = Window.partitionBy(*keys).orderBy(*numbers) if numbers else Window.partitionBy(*keys).orderBy(F.lit(0))
    placed = {
        s: df.join(open_, list(by), "left_semi").withColumn("_place", F.row_number().over(order)) for s, df in sides.items()
    }
    left, right = placed["expected"].alias("e"), placed["actual"].alias("a")
    same = F.lit(True)
    for c in [*keys, "_place"]:
        same &= F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}"))
    fits = F.lit(True)
    for c in numbers:
        fits &= _close(F.col(f"a.{c}"), F.col(f"e.{c}"), tolerance)
    agreed = left.join(right, same & fits).groupBy(*[F.col(f"e.{c}").alias(c) for c in by]).agg(F.count("*").alias("_agreed"))
    judged = F.when(F.col("_agreed") == F.col("expected_rows"), "within").otherwise("wrong")
    return met.join(agreed, list(by), "left").withColumn("verdict", F.coalesce("verdict", judged)).drop("_agreed")


def accuracy(compared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, questions, correct, accuracy) of `compare_answers`."""
    right = F.col("verdict").isin("equal", "within")
    return compared.groupBy(*by).agg(
        F.count("*").alias("questions"), F.count_if(right).alias("correct"), F.avg(right.cast("double")).alias("accuracy")
    )
