"""Session construction and the shared scratch folder.

On a cluster the scratch folder is whatever ``spark.checkpoint.dir`` names
(a shared, fault-tolerant file system). Only when it is unset -- local runs
and tests -- do we create one of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


# Settings for a large cluster reading ~100 TB: big scan splits, many initial
# shuffle partitions that AQE coalesces to ~256 MB each, and skew splitting of
# any shuffle partition 5x the median and above 512 MB.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "tersus", extra: dict | None = None, cluster: bool = False) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if cluster:
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: The folder that holds the package.
PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def let_workers_import(spark: SparkSession) -> None:
    """Python workers on the driver's machine import this package from where the driver did. On a cluster the
    package is installed, or sent with ``--py-files``, as usual."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, PACKAGE_ROOT])


def scratch_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh sub-folder of the cluster's shared checkpoint folder.

    Reads ``spark.checkpoint.dir`` (or the SparkContext checkpoint dir). If
    neither is set, a local master gets a folder of its own; any other master
    raises, because executors would not see a folder made on the driver.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        try:
            base = spark.sparkContext.getCheckpointDir()
        except Exception:
            base = None
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tersus-ckpt-")
        try:
            spark.sparkContext.setCheckpointDir(base)
        except Exception:  # sessions without a SparkContext handle: the folder is still usable
            pass
    path = os.path.join(base, *parts, uuid.uuid4().hex[:12]) if parts else os.path.join(base, uuid.uuid4().hex[:12])
    return path
