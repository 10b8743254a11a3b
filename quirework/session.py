"""Session settings and the few helpers that touch shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only when both bounds hold; past either, the caller takes its shuffle path.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 16 * 1024 * 1024

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings every job here expects. Shuffle width is left to the cluster and to AQE."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config(STATE_STORE, ROCKSDB)
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master with nothing configured gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="quirework-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def run_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, so a re-run never reads an older run's files."""
    return f"{shared_dir(spark).rstrip('/')}/quirework/{what}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once and go on from the files.

    The data outlives any executor, the plan stays short, and readers prune columns. Unlike an RDD
    checkpoint, the input is worked out once, not twice.
    """
    path = run_path(df.sparkSession, "step")
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, text_cols: list[str]) -> bool:
    """Whether a dimension table is provably small: measured row count and text bytes."""
    size = F.lit(0).cast("long")
    for c in text_cols:
        size = size + F.coalesce(F.octet_length(c).cast("long"), F.lit(0))
    row = df.limit(BROADCAST_ROWS + 1).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")
    ).first()
    return row["n"] <= BROADCAST_ROWS and row["b"] <= BROADCAST_BYTES
