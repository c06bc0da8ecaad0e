"""Session helpers: settings sized for large inputs, and the shared work folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of this library expects. AQE re-plans at run time: it
# coalesces small shuffle partitions, splits skewed join partitions and turns
# a sort-merge join into a broadcast only when the measured side is small.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "promolift", extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Get or create a session with the library's settings.

    On a cluster, leave ``master`` unset (spark-submit decides) and size
    ``shuffle_partitions`` to the data (about 128-256 MB per partition).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", os.environ.get("PROMOLIFT_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and derived tables, one for each application.

    Uses the cluster's ``spark.checkpoint.dir``. Only in local mode with none
    set (tests) a fresh local folder is made and registered; on a cluster a
    missing setting is an error.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        # Spark makes a folder of the application's own below it; every call returns that one.
        spark.sparkContext.setCheckpointDir(configured)
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        # Executors on other machines cannot see a driver-local folder.
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, object store) "
                           "for the tables this library writes")
    local = tempfile.mkdtemp(prefix="promolift-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir().rstrip("/")
