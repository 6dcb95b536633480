"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "tidewatch", shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build a local one configured for these operators.

    On a cluster the session normally already exists (spark-submit); we only
    set options that are safe to override. Locally we size shuffle partitions
    to the core count and keep the UI off.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        _ensure_checkpoint_dir(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(os.environ.get("TIDEWATCH_SHUFFLE_PARTITIONS", cpus))
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # broadcast only what the planner can prove small; explicit hints are size-checked by callers
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .config("spark.driver.memory", os.environ.get("TIDEWATCH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    _ensure_checkpoint_dir(spark)
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only set one when unset (local tests)."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        current = tempfile.mkdtemp(prefix="tidewatch-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
        spark.sparkContext.setCheckpointDir(current)
    elif not (spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None):
        spark.sparkContext.setCheckpointDir(current)
    return current


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and staged tables (never a machine-local path on a cluster)."""
    return _ensure_checkpoint_dir(spark)


_owners: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Owner of the intermediate tables that operators write to the shared folder inside the block: they are
    deleted when it ends. Write or collect the results inside; lazy results that outlive it have lost their tables."""
    paths: list[str] = []
    _owners.append(paths)
    try:
        yield
    finally:
        _owners.remove(paths)
        for path in paths:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def owned(path: str) -> str:
    """The path of a new intermediate table, noted for the innermost `scratch_tables` block, if there is one."""
    if _owners:
        _owners[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to a fresh shared folder and read back: computed once, no cache to
    release, and a lost executor takes nothing with it."""
    path = owned(f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
