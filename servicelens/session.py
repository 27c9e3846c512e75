"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings the plans are written for. Partition counts are left to AQE: it starts from
# `initialPartitionNum`, merges small shuffle partitions and splits skewed ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

_fallback_dirs: dict[str, str] = {}


def build_session(
    app_name: str = "servicelens", master: str | None = None, **conf: str
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`.

    A session that runs in this process alone (`local`, not `local-cluster`) may go without: it then
    gets a temporary folder, which is as shared as its files ever are.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app_id = spark.sparkContext.applicationId
    if app_id not in _fallback_dirs:
        _fallback_dirs[app_id] = tempfile.mkdtemp(prefix="servicelens-")
    return _fallback_dirs[app_id]


def staging_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def share_package(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package where the driver did.

    On a cluster it must be installed or sent along with `--py-files`.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])
