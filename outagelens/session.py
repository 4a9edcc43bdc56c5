"""Session helpers: UTC clock, AQE, and a shared checkpoint directory."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_RUN_ID = uuid.uuid4().hex

# Runtime-settable SQL options every operator relies on.
_SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # let AQE coalesce / re-plan the output partitioning of persisted intermediates too
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
}


# Rows that Spark hands to Python at a time, where the session still has Spark's default of 10,000: with whole texts
# the buffers of such a batch, on both sides and for each task, outweigh the data that is worked on.
_ARROW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "500")


def configure(spark: SparkSession) -> SparkSession:
    """Pin the options the library's semantics depend on (idempotent)."""
    name, default, rows = _ARROW_ROWS
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, rows)
    for key, value in _SQL_DEFAULTS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is. Only where it is unset on a local master (tests) a fresh scratch folder is
    created and registered; on a cluster an unset folder is an error, since executors
    don't share a machine's temporary folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions expose no SparkContext
        sc = None
    current = (sc.getCheckpointDir() if sc is not None else None) or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if sc is not None and not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a shared folder (master {master!r} is not local)")
    path = tempfile.mkdtemp(prefix="outagelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc is not None:
        sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under the shared checkpoint dir, of this process alone.

    Two sessions that share the folder never write to each other's tables.
    """
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{_RUN_ID}/{name}"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "outagelens") -> SparkSession:
    """Session for tests and the local bench (UI off, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    checkpoint_dir(spark)
    return spark

