"""Session helpers. On a cluster the session comes from outside and is left as it is."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tapewell")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or 8))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's ``spark.checkpoint.dir``.

    A folder of our own is set only where none is configured, which is the case in local tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "") or ""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not configured:
        configured = tempfile.mkdtemp(prefix="tapewell-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def table(spark: SparkSession, folder: str, name: str):
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, least: int | None = None) -> DataFrame:
    """``rows`` in at least ``least`` partitions (all cores if not given; 0 leaves them as they are).

    A file of a few megabytes is one split, and work in Python on it would use one core. Rows that come in fewer
    partitions are shuffled into that many; a table that the scan splits far enough isn't moved. The rows are the same.
    """
    wanted = rows.sparkSession.sparkContext.defaultParallelism if least is None else least
    return rows.repartition(wanted) if wanted and rows.rdd.getNumPartitions() < wanted else rows
