"""Delivery manifest: which files came when, found by tasks and kept as a table.

A scan knows the names of its files on the driver, and skips files of zero bytes. Here tasks list the folders, one
level after the other, and what they find stays a table: also empty files, and how the lines of large files end.
The manifest holds every file that was taken in. What a later listing finds beyond it, or with another size or
time, is new.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import share_package, staging_path
from ..tables import values_table
from .exports import SPLIT_ABOVE
from .store import save_table

FILES = "file string, name string, bytes bigint, modified timestamp, line_end string"
MANIFEST = f"{FILES}, delivery bigint"

#: Bytes at the start of a large file that tell how its lines end.
HEAD_BYTES = 1 << 16

_FOUND = (
    "path string, folder boolean, file string, name string, bytes bigint, modified timestamp, line_end string"
)


def _file_uri(path: str, scheme: str) -> str:
    """A path as scans show it: with its scheme, and characters that URIs lack as %XX."""
    quoted = re.sub(r"[^A-Za-z0-9_.!~'()*,;:$&+=/@\x80-\U0010FFFF-]", lambda m: f"%{ord(m[0]):02X}", path)
    return f"{scheme}{quoted}"


def first_line_end(head: bytes) -> str | None:
    """How the first record ends: `lf`, `crlf`, `cr`, or None if it does not end here. Breaks inside quotes are
    part of a cell.
    """
    outside = re.match(rb'(?:[^"\r\n]|"[^"]*(?:"|\Z))*+(\r\n|\n|\r(?!\Z))?', head)
    return {b"\n": "lf", b"\r\n": "crlf", b"\r": "cr"}.get(outside[1] if outside else None)


def _listed(batches: Iterator[pa.RecordBatch], head_above: int) -> Iterator[pa.RecordBatch]:
    """The entries of the folders in `path`."""
    kinds = [pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string()]
    names = ["path", "folder", "file", "name", "bytes", "modified", "line_end"]
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            given = re.match(r"([a-z][a-z0-9+.-]*:)/+", folder)
            # file:/x and file:///x are one; other stores keep their authority
            local = given is None or given[1] == "file:"
            plain = re.sub(r"^file:/+", "/", folder) if local else folder
            store, at = (pa.fs.LocalFileSystem(), plain) if local else pa.fs.FileSystem.from_uri(folder)
            prefix = "file:" if local else re.match(r"[a-z][a-z0-9+.-]*://[^/]*", folder)[0]
            rows = []
            for entry in store.get_file_info(pa.fs.FileSelector(at)):
                hidden = entry.base_name.startswith(".") or re.match("_[^=]*$", entry.base_name)
                if hidden:  # to scans as well
                    continue
                is_folder = entry.type == pa.fs.FileType.Directory
                end = None
                if not is_folder and entry.size > head_above:
                    with store.open_input_stream(entry.path) as stream:
                        end = first_line_end(stream.read(HEAD_BYTES))
                uri = _file_uri(entry.path if entry.path.startswith("/") else "/" + entry.path, prefix)
                path = entry.path if local else prefix + "/" + entry.path.lstrip("/")
                # scans tell times in milliseconds
                changed = None if is_folder else entry.mtime.replace(microsecond=entry.mtime.microsecond // 1000 * 1000)
                rows.append((path, is_folder, uri, entry.base_name, entry.size, changed, end))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def discover(spark: SparkSession, paths: str | Sequence[str], head_above: int = SPLIT_ABOVE) -> DataFrame:
    """(file, name, bytes, modified, line_end) of every file below some folders, empty ones too.

    Each level of folders is a job whose tasks list the folders they are given; the driver learns only whether
    there is a further level. `line_end` is read from the head of files above `head_above` bytes and NULL for
    others. Executors must reach the folders by the same path, as they must for any scan; stores that pyarrow
    cannot open are errors.
    """
    share_package(spark)
    folders = values_table(spark, [(p,) for p in ([paths] if isinstance(paths, str) else paths)], "path string")
    levels = []
    while True:
        dealt = folders.repartition(F.xxhash64("path"))
        found = dealt.mapInArrow(lambda batches: _listed(batches, head_above), _FOUND)
        levels.append(save_table(found, staging_path(spark, "listing")))
        folders = levels[-1].where("folder").select("path")
        if folders.isEmpty():
            break
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.where(~F.col("folder")).select("file", "name", "bytes", "modified", "line_end")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files taken in so far, with the number of their delivery; empty before the first."""
    try:
        return spark.read.schema(MANIFEST).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return values_table(spark, [], MANIFEST)


def new_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """The files that the manifest does not hold with this size and time of modification."""
    return found.join(manifest.select("file", "bytes", "modified"), ["file", "bytes", "modified"], "left_anti").select(
        *found.columns
    )


def record_delivery(spark: SparkSession, files: DataFrame, path: str, delivery: int) -> DataFrame:
    """Add files to the manifest under the number of their delivery and return them as kept.

    A delivery recorded again replaces what its number held, so a step that broke off can be repeated.
    """
    (
        files.withColumn("delivery", F.lit(delivery).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("delivery")
        .parquet(path)
    )
    return read_manifest(spark, path).where(F.col("delivery") == delivery).drop("delivery")


def return_files(files: DataFrame) -> list[str]:
    """The large files whose records end with a carriage return alone, by name, to be cut there."""
    return [r["file"] for r in files.where(F.col("line_end") == "cr").select("file").collect()]


def delivery_summary(manifest: DataFrame, verdicts: DataFrame, by: Sequence[Column] = ()) -> DataFrame:
    """(delivery, by, files, bytes, empty, accepted, rows): what came with each delivery and what of it counts."""
    judged = verdicts.select("file", "verdict", "rows")
    accepted = F.col("verdict") == "ok"
    return (
        manifest.join(judged, "file", "left")
        .groupBy("delivery", *by)
        .agg(
            F.count("*").alias("files"),
            F.sum("bytes").alias("bytes"),
            F.count_if(F.col("bytes") == 0).alias("empty"),
            F.count_if(accepted).alias("accepted"),
            F.coalesce(F.sum(F.when(accepted, F.col("rows"))), F.lit(0)).alias("rows"),
        )
    )


