"""Session helpers.

``get_session`` is for tests, the bench and command-line use; on a cluster the
session comes from the platform and only ``ensure_checkpoint_dir`` applies.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


NO_SHARED_FOLDER = "set spark.checkpoint.dir to a folder that the driver and all executors share"


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "lumen") -> SparkSession:
    builder = (
        SparkSession.builder
        .master(master or os.environ.get("LUMEN_MASTER", "local[8]"))
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LUMEN_DRIVER_MEMORY", "16g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names in ``spark.checkpoint.dir``. Unset in local
    mode, a scratch folder is made; unset elsewhere is an error, since executors do not
    share the driver's disk."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a remote (Connect) session has no context handle
        sc = None
    if sc is None:
        if configured:
            return configured
        raise RuntimeError(NO_SHARED_FOLDER)
    current = sc.getCheckpointDir()
    if current:
        return current
    local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
    if not configured and not local:
        raise RuntimeError(NO_SHARED_FOLDER)
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lumen-ckpt-"))
    return sc.getCheckpointDir()
