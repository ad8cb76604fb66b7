"""Session helpers.

The library never creates a global session on import; callers pass one in.
``local_session`` is for tests, the bench and the examples.
"""
from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tabwork") -> SparkSession:
    """A local session with the settings used by tests and the bench.

    AQE is on so partition counts coalesce at run time; the UI is off (no
    port); the session time zone is UTC so NTZ timestamps compare cleanly
    with DuckDB.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TABWORK_DRIVER_MEM", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; set a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is left
    alone.  Local runs without it (tests, the bench) get a fresh folder under /tmp; on a cluster
    that folder would be a different disk on every executor, so the setting is required there.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc_dir = spark.sparkContext.getCheckpointDir()
    if current:
        if not sc_dir:
            spark.sparkContext.setCheckpointDir(current)
        return current
    if sc_dir:
        return sc_dir
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="tabwork-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def spread(df):
    """Round-robin a scan that yields fewer partitions than the cluster has cores.

    A file with a single row group is read by one task, which would leave all
    narrow work after it (regexes, moments) on one core.  Large inputs already
    arrive in many splits and pass through untouched, so no shuffle is added
    where it would only cost.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    current = df.rdd.getNumPartitions()
    if current >= cores:
        return df
    # about one partition per 256 KiB of (compressed) input, so a tiny lookup table on a large
    # cluster does not become thousands of empty tasks
    from .functions.columns import estimated_bytes
    target = min(cores, max(2, -(-estimated_bytes(df) // (1 << 18))))
    return df.repartition(target) if target > current else df


def table(spark: SparkSession, sf_dir: str, name: str):
    """Read one of the driver tables (parquet), spread over the cores if it is one split."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))
