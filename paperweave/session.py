"""Session set-up and the shared folder that survives the loss of an executor."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "paperweave", **conf: str) -> SparkSession:
    """A session with the settings every job here expects; a cluster's own settings win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints and landed tables.

    Only a local session may fall back to a folder of its own: elsewhere a machine-local path would be
    lost with its machine.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="paperweave-")
    context.setCheckpointDir(own)
    return own


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return os.path.join(shared_dir(spark), "paperweave", f"{name}-{uuid.uuid4().hex}")


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and go on from the files.

    Used where several jobs read the same derived table: the files cut the lineage and survive a lost
    executor, which a cache does not.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a table whose files have too few row groups; elsewhere leave it as it is.

    Heavy work per text would otherwise run in as few tasks as there are row groups.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
