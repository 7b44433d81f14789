"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library is designed for. On a cluster they belong in the job
# submission; `build_session` applies them for local runs and tests.
RECOMMENDED_CONF = {
    # Re-plan at runtime: coalesce small shuffle partitions, turn joins whose
    # measured side is small into broadcast joins, split skewed partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Item-level joins on claim_id are often followed by a second join on the
    # same key; split a hot claim even if that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# A date range selects headers; their claims, as a Bloom filter, reduce the item scan before the shuffle. Spark
# plans that by sizes it only guesses for a filtered table, so its bounds are wide; a filter has 8 MB at most.
RANGE_FILTER_CONF = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
}
RECOMMENDED_CONF |= RANGE_FILTER_CONF


def build_session(
    master: str | None = None, shuffle_partitions: int | None = None, app_name: str = "disputelens", extra: dict | None = None
) -> SparkSession:
    """A session with the recommended settings.

    Master and shuffle partitions are those of the submission unless given.
    """
    settings = dict(RECOMMENDED_CONF)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings |= extra or {}
    builder = SparkSession.builder.appName(app_name).config(map=settings)
    if master is not None:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the job submission and points at shared
    storage; it is only read here. When it is unset, a local master (one
    machine) gets a private folder as the context's checkpoint directory; on
    any other master that folder would exist on the driver alone, so this
    raises ``RuntimeError``.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="disputelens-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path


def checkpointed(df):
    """``df`` computed once and kept in the shared checkpoint folder; its lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")
