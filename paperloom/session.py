"""Session settings and the shared folder used for checkpoints and interim tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Settings the jobs rely on.  Cluster sizing (executors, memory, shuffle
#: partitions) stays with spark-submit; AQE coalesces and splits from there.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot partition even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # lets `row_number() <= k` prune on the map side for every configured cap
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Settings that can only be given when a session starts.
STARTUP = {
    # no call-site capture for every column expression; plans here have thousands
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "paperloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**STARTUP, **SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path for `purpose` below the folder in ``spark.checkpoint.dir``.

    The folder must be visible to every executor.  Only a local session may fall
    back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Rows of an id list that may be broadcast; a longer one is joined by shuffle.
BROADCAST_IDS = 500_000


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Cuts the lineage, so several uses compute it once, and survives lost executors.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def counted(ids: DataFrame) -> DataFrame:
    """Mark a materialised id list for broadcast if it is short enough, by its row count."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable, keeping a folder that is already set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "lineage"))
