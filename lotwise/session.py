"""Session and checkpoint helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows one task may hold for a single key before the key counts as hot. Windows spill, so this bounds time, not memory.
DEFAULT_HOT_ROWS = 5_000_000
# Lookup tables with more rows than this are joined by shuffle instead of broadcast.
DEFAULT_BROADCAST_ROWS = 200_000


def build_session(app: str, master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false"
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.lotwise.hotRows", str(DEFAULT_HOT_ROWS)))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.lotwise.broadcastRows", str(DEFAULT_BROADCAST_ROWS)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back to a temporary one in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))


def stage(df: DataFrame) -> DataFrame:
    """Write a derived table to Parquet in the shared checkpoint folder and read it back.

    Used where several consumers need the same rows: it cuts the lineage, survives lost executors, and later scans
    still prune columns. The folder's owner clears it with the other checkpoints.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pin(df: DataFrame) -> DataFrame:
    """Checkpoint a small derived table so that every later use sees the same rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
