"""Session helpers: build a local session for tests and resolve shared paths."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  checkpoint_dir: str | None = None) -> SparkSession:
    """A local session for tests and the bench (the cluster brings its own)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("msgsift")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MSGSIFT_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, checkpoint_dir)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster's ``spark.checkpoint.dir`` wins. A folder is only set here
    when none is configured: the given ``fallback``, or, in local mode only
    (tests), a fresh temporary folder. On a cluster with no setting this
    fails rather than write stages to a machine-local folder.
    """
    conf = spark.sparkContext.getConf()
    current = conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if fallback is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder shared by all executors")
        import tempfile
        fallback = tempfile.mkdtemp(prefix="msgsift-ckpt-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


ARROW_ROWS = 1_000   # rows of an Arrow batch that carries token or id arrays


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the session's Arrow batches to ``rows`` rows: arrays make big rows, and the Python worker of every running
    task holds a batch and several arrays of its size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Write a stage to the shared folder and read it back.

    Cuts lineage so a lost executor re-reads the written table instead of
    recomputing the upstream plan.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").format(fmt).save(path)
    return spark.read.schema(df.schema).format(fmt).load(path)   # known schema: no footer scan
