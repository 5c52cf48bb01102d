"""Session construction and shared-storage locations.

The library never invents storage on a cluster: state, landing files and
checkpoints live under ``spark.checkpoint.dir`` (a shared folder the cluster
names). Only when that setting is absent -- local runs and tests -- a private
scratch directory is created and registered as the checkpoint dir.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults that make a plan scale: AQE re-plans joins and coalesces shuffle
# partitions at runtime, skew join splitting handles a company that holds a
# third of the rows, and timestamps are interpreted in UTC everywhere.
SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    # skip capturing the Python call site of every DataFrame call (error context only)
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, cpus: int | None = None,
                  app_name: str = "auditlake", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the scale defaults.

    ``cpus`` sizes ``spark.sql.shuffle.partitions`` for local runs; on a
    cluster leave it ``None`` and let the cluster config (plus AQE
    coalescing) decide.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in SCALE_DEFAULTS.items():
        builder = builder.config(k, v)
    if cpus:
        builder = builder.config("spark.sql.shuffle.partitions", str(max(2, cpus)))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_utc(spark)
    return spark


def ensure_utc(spark: SparkSession) -> SparkSession:
    """All stored times are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Set here only when unset (local runs, tests); on a cluster the value
    comes from the cluster configuration and must be shared storage.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jdir.get() if jdir.isDefined() else None
    if not root:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            # a machine-local folder is invisible to other executors and lost
            # with the machine: refuse instead of guessing
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="auditlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/auditlake/{name}-{uuid.uuid4().hex[:12]}"


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
