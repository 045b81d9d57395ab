"""Session settings and scratch space shared by the jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. Everything else is left to the cluster.
SETTINGS = {
    # Two equal keys in one JSON object: the last one wins, as in Python.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Keyed streaming state spills to disk instead of living on the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


#: Bytes of rows that travel to a Python worker at once. By default all documents of a task may be one batch, which both the
#: executor and the worker hold beside the heap.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def small_batches(spark: SparkSession) -> None:
    """Have rows sent to Python workers in small batches, for jobs whose rows are whole texts."""
    spark.conf.set(*BATCH_BYTES)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for written intermediate tables.

    It lies below the shared folder named by ``spark.checkpoint.dir``. Only a
    local session may fall back to a temporary folder of the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="harvestlens-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread an input that comes in fewer splits than there are cores, before costly row-wise work.

    Such an input is small (at most one split size per core); a large one has
    more splits than cores and is left alone, so its rows are never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
