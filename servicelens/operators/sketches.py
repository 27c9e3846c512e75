"""Column profiles from mergeable sketches, kept by source.

A profile over all sources need not read their rows again. Each source keeps, per column, a sketch of its distinct
values (HyperLogLog), of the distribution of its numbers (KLL) and of its frequent values, beside exact counts and
bounds. A delivered source replaces its sketches; profiles merge what is kept, a few kilobytes a source and column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the register number of HyperLogLog; the standard error of a distinct count is 1.04 / sqrt(2 ** bits).
DISTINCT_BITS = 12
DISTINCT_ERROR = 1.04 / 2 ** (DISTINCT_BITS / 2)

#: Size of KLL sketches; a quantile's rank is off by less than this share of the rows, in 99 of 100 cases.
QUANTILE_K = 200
QUANTILE_ERROR = 0.0133

#: Values that a sketch of frequent values follows. A count is off by less than this share of the rows; of columns
#: with three quarters as many values or fewer, counts are exact.
FOLLOWED = 4096
FREQUENT_ERROR = 3.5 / (2 * FOLLOWED)

_COLUMNS = ("column", "type", "rows", "nulls", "min_value", "max_value", "distinct", "quantiles", "frequent")


def _number(c: Column, kind: T.DataType) -> Column:
    """A column's values as doubles: numbers, and times as seconds; others have no distribution."""
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_seconds(c.cast("timestamp")).cast("double")
    return F.lit(None).cast("double")


def sketch(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(by, column, type, rows, nulls, min_value, max_value, distinct, quantiles, frequent) in one pass.

    Tasks sketch what they read, so a source with most of the rows is a row a task in the shuffle.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    aggregates, rows = [], []
    for i, name in enumerate(columns):
        c, shown = F.col(name), F.col(name).cast("string")
        exprs = (
            F.lit(name),
            F.lit(types[name].simpleString()),
            F.count("*"),
            F.count_if(c.isNull()),
            F.min(c).cast("string"),
            F.max(c).cast("string"),
            F.hll_sketch_agg(shown, F.lit(DISTINCT_BITS)),
            F.kll_sketch_agg_double(_number(c, types[name]), F.lit(QUANTILE_K)),
            F.call_function("approx_top_k_accumulate", shown, F.lit(FOLLOWED)),
        )
        aggregates += [e.alias(f"_{i}_{n}") for n, e in zip(_COLUMNS[2:], exprs[2:], strict=True)]
        rows.append(
            F.struct(
                exprs[0].alias("column"), exprs[1].alias("type"), *[F.col(f"_{i}_{n}").alias(n) for n in _COLUMNS[2:]]
            )
        )
    return df.groupBy(by).agg(*aggregates).select(by, F.inline(F.array(*rows)))


def keep_sketches(sketches: DataFrame, path: str, by: str) -> None:
    """Write sketches by source; those of a source replace its earlier ones."""
    (
        sketches.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged_profile(sketches: DataFrame, keys: Sequence[str] = (), top: int = 3) -> DataFrame:
    """A profile per column, and per `keys` if there are any, from kept sketches alone.

    rows, nulls, min_value and max_value are exact (bounds compare as the text of numbers and times does not, so
    they are those of the type where it has one). distinct_values comes with the bounds that hold in 997 of 1,000
    cases, quartiles with ranks off by up to `QUANTILE_ERROR`, frequent values with counts off by up to
    `FREQUENT_ERROR` of the rows.
    """
    number = lambda c: F.col(c).try_cast("double")

    def bound(pick, pick_by) -> Column:
        c = pick.__name__ + "_value"
        return F.when(F.every(F.col(c).isNull() | number(c).isNotNull()), pick_by(c, number(c))).otherwise(pick(c))

    merged = sketches.groupBy(*keys, "column").agg(
        F.any_value("type").alias("type"),
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        bound(F.min, F.min_by).alias("min_value"),
        bound(F.max, F.max_by).alias("max_value"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_values"),
        F.kll_merge_agg_double("quantiles").alias("_quantiles"),
        F.call_function(
            "approx_top_k_estimate", F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(FOLLOWED)), F.lit(top)
        ).alias("frequent"),
    )
    spread = 3 * DISTINCT_ERROR
    given = F.kll_sketch_get_n_double("_quantiles") > 0
    quartiles = F.kll_sketch_get_quantile_double("_quantiles", F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)]))
    return merged.select(
        *keys,
        "column",
        "type",
        "rows",
        "nulls",
        "min_value",
        "max_value",
        "distinct_values",
        F.floor(F.col("distinct_values") / (1 + spread)).alias("distinct_low"),
        F.ceil(F.col("distinct_values") / (1 - spread)).alias("distinct_high"),
        F.when(given, quartiles).alias("quartiles"),
        "frequent",
    )
