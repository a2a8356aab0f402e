"""Session construction and the few settings every job depends on.

The engine relies on three session properties:

* ``spark.sql.session.timeZone=UTC`` -- bucket floors and date partitions are
  UTC-aligned, and the fixture files carry TIMESTAMP_NTZ values that must not
  shift with the machine zone when cast to TIMESTAMP.
* ``spark.sql.variant.allowDuplicateKeys=true`` -- a JSON record with a key
  twice keeps the last value, as a JavaScript ``JSON.parse`` does.
* a shared ``spark.checkpoint.dir`` -- lineage is cut with ``checkpoint()``
  or with written tables, never with machine-local storage.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings applied to sessions this package builds. On a cluster the same keys
# belong in spark-defaults; ``configure`` only sets them where unset.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app_name: str = "relaywatch",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine defaults.

    ``master`` defaults to ``local[$BENCH_CPUS or *]`` so tests and the bench
    run in one JVM; on a cluster pass nothing and let spark-submit decide.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is None and "SPARK_MASTER" not in os.environ and not os.environ.get("SPARK_REMOTE"):
        master = f"local[{os.environ.get('BENCH_CPUS', '*')}]"
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false")
    if master and master.startswith("local"):
        # local mode runs every task in the driver JVM
        builder = builder.config("spark.driver.memory", os.environ.get("RELAYWATCH_DRIVER_MEMORY", "12g"))
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the engine's required SQL settings to an existing session."""
    for k in ("spark.sql.session.timeZone", "spark.sql.variant.allowDuplicateKeys"):
        spark.conf.set(k, DEFAULT_CONF[k])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only a local-mode session (tests, the
    bench) without one gets a fresh scratch folder; a cluster session without
    one is a configuration error, because a machine-local folder would not
    survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage")
    path = tempfile.mkdtemp(prefix="relaywatch-ckpt-")
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path
