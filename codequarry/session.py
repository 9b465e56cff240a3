"""Session helpers: the shared folder and written intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid

from contextlib import contextmanager
from math import ceil

from pyspark.sql import DataFrame, SparkSession

ROWS_A_TASK = 50_000  # narrow rows that costly row functions get in one task
TASK_BYTES = "4m"  # of a shuffle whose rows compress so well that their bytes say little about a task's memory
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach, as the cluster names it.

    Falls back to a temporary folder only when the setting is absent and all
    executors are threads of this process (tests); anywhere else a machine-local
    folder would be lost with its machine, so that case is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="codequarry-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/codequarry/{label}-{uuid.uuid4().hex}"


@contextmanager
def task_bytes(spark: SparkSession, size: str | None):
    """Shuffle partitions are joined up to ``size`` compressed bytes only, while this lasts; None leaves that as set."""
    before = spark.conf.get(ADVISORY)
    if size:
        spark.conf.set(ADVISORY, size)
    try:
        yield
    finally:
        spark.conf.set(ADVISORY, before)


def materialize(df: DataFrame, label: str = "stage", size: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage (a lost executor re-reads files instead of recomputing) and
    fixes values that would differ between recomputations, such as range
    partition numbers.  ``size`` bounds the shuffled bytes of one task.
    """
    path = scratch_path(df.sparkSession, label)
    with task_bytes(df.sparkSession, size):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan in fewer partitions than there are cores, spread over all of them.

    For a few unsplittable files in front of costly row functions; a scan of
    many partitions is left as it is, so there is no shuffle at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """A table of narrow rows dealt out by their number, in front of functions that make long texts of them.

    The bytes of the files say nothing about that work, so the scan's partitions do not grow with it.  Only narrow
    rows are shuffled, and a table that is spread enough already is left as it is.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, ceil(df.count() / rows))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def shuffled(df: DataFrame) -> DataFrame:
    """Joined by shuffling both sides, never sent whole through the driver.

    For tables that grow with the input and whose size the optimizer guesses from compressed files.
    """
    return df.hint("merge")
