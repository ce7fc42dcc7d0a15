"""Spark session and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where a later step on the same key then needs its own shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Stored frames leave the checkpoint folder once nothing refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.checkpoint.compress": "true",
}


def get_session(app_name: str = "tallygrove", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time, adaptive execution and skew-join splitting.

    Memory, shuffle partitions and the checkpoint folder stay with the cluster;
    pass them in ``conf`` (dots written as ``__``) to set them here.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def stored(df: DataFrame) -> DataFrame:
    """A frame that several later steps read, computed once and kept in the checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder for one written table.

    All paths of an application lie in one folder, which goes when its driver ends.
    """
    root = f"{shared_dir(spark).rstrip('/')}/scratch-{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    store.deleteOnExit(folder)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let executors drop shuffle files and stored frames that nothing refers to any more.

    Spark clears them when the driver's objects are collected; with much free memory there that can be long after the step.
    """
    gc.collect()
    spark._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """A wide frame that several later steps read by column, kept as Parquet in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
