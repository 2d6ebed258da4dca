"""Session settings the operators rely on, and reuse of shared results."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Time stamps in the sources carry no zone; day and hour buckets are UTC.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    # Sums that overflow are errors.
    "spark.sql.ansi.enabled": "true",
    # What one task reads, and so what it sums up in memory, does not grow with the tables.
    "spark.sql.files.maxPartitionBytes": "16MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32MB",
    # A side whose partitions are all that small is hashed, and the other one, such as all usage, is not sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "32MB",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on to a running session."""
    for key, value in SESSION_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "spendscope") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    partitions = cores if isinstance(cores, int) else 8
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # Query plans name no Python call sites; noting them slows plan building down.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def own_folder(master: str) -> bool:
    """Whether driver and executors are one process, so that a folder of this machine is shared."""
    return master == "local" or master.startswith("local[")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute a result once and keep it in reliable storage.

    For small results that many later plans read. The files go to the folder that
    the cluster names in ``spark.checkpoint.dir``, so they outlive any executor.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not own_folder(context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spendscope-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def few_at_once(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of so many bytes, for large rows; for what runs in the block."""
    before = spark.conf.get(_BATCH_SETTING)
    spark.conf.set(_BATCH_SETTING, str(size))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)
