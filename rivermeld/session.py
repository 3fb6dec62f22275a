"""Session helpers: local session for tests, the shared work folder, and size-checked broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A reference table is broadcast only when a count proves it has at most this many rows.
BROADCAST_ROWS = 200_000

_fallback_folder: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session and settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rivermeld")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("RIVERMELD_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the workers once per application, so that jobs run from any working folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="run-"), "rivermeld"), "zip",
                                  os.path.dirname(top), os.path.basename(top))
    context.addPyFile(archive)  # Spark's own file service hands it to every executor
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    A temporary folder is used only for a local master that leaves the setting empty.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _fallback_folder:
        _fallback_folder[app] = tempfile.mkdtemp(prefix="run-")
        context.setCheckpointDir(os.path.join(_fallback_folder[app], "checkpoints"))
    return _fallback_folder[app]


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder for one written result."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows_per_task: int, *keys: str) -> DataFrame:
    """Partition a counted frame for heavy work per row.

    Adaptive execution sizes partitions by bytes and would put few but expensive rows into one task.
    """
    tasks = max(-(-df.count() // rows_per_task), 1)
    return df.repartition(tasks, *keys) if keys else df.repartition(tasks)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when a count proves the side small; else leave the choice to AQE."""
    if df.count() <= max_rows:  # counted in all tasks; a limit would gather its rows in one
        return F.broadcast(df)
    return df
