"""Helpers of the corpus operators: reading tables, shared intermediate tables, bounded slices of texts."""

from __future__ import annotations

import itertools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from servicelens.session import staging_path

#: The folder that holds the package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Characters that a Python task turns into lists at a time. Bounds memory, not results: a longer
#: text is a slice of its own.
SLICE_CHARS = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder that `spark.checkpoint.dir` names and read again: cuts the lineage."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def map_arrow(df: DataFrame, task: Callable, schema: str | StructType) -> DataFrame:
    """`mapInArrow` for tasks that import this package.

    Workers on this machine find it where the driver did. On a cluster it must be installed or sent along
    with `--py-files`.
    """
    known = df.sparkSession.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return df.mapInArrow(task, schema)


def row_key(*columns: str) -> Column:
    """A key of the values of a row, nulls included. Equal rows share it and get equal results.

    It has 128 bits: among 10^12 different rows the chance that two share one is below 10^-14.
    """

    def framed(c: Column) -> Column:
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))

    return F.unhex(F.md5(F.concat(*[framed(F.col(c).cast("string")) for c in columns])))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about `limit` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def sliced(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    return itertools.chain.from_iterable(slices(batch, text) for batch in batches)


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(text).to_pylist()]


class WordCache(dict):
    """Results by word. Beyond `limit` words only those of the current slice stay, so memory is bounded."""

    def __init__(self, limit: int = 400_000, longest: int = 64):
        super().__init__()
        self.limit, self.longest = limit, longest

    def missing(self, words: set[str]) -> list[str]:
        return [w for w in words if w not in self]

    def shrink(self, words: set[str]) -> None:
        if len(self) > self.limit:
            kept = {w: self[w] for w in words if w in self and len(w) <= self.longest}
            self.clear()
            self.update(kept)
