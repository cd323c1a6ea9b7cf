"""Session helpers: a builder with defaults sized for the copy/check work, and
the shared work folder every job writes to.

Library operators never change a caller's configuration; only ``build_session``
(used by tests, the bench and scripts) sets any.  A local session without a
checkpoint folder is given a temporary one when it first needs it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults for sessions we create ourselves.  Broadcasts are left to AQE,
# which decides on measured shuffle sizes instead of file-size estimates, so a
# side is only broadcast when its real size is known to be small.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.scheduler.mode": "FAIR",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "migrakit", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.

    On a cluster it must be set (a machine-local folder would not be seen by
    other executors and would not survive their loss).  Only a local session
    without one gets a fresh folder of its own.
    """
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    # A local session without a folder: one of its own, for this session only.
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="migrakit-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def work_dir(spark: SparkSession, *parts: str, fresh: bool = True) -> str:
    """A folder under the shared root; ``fresh`` adds a unique leaf per run."""
    segs = ["migrakit", *(p.strip("/") for p in parts)]
    if fresh:
        segs.append(uuid.uuid4().hex[:12])
    return shared_root(spark) + "/" + "/".join(segs)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Deletes a run's folder under the shared root (and nothing outside it)."""
    root = shared_root(spark)
    if not path.rstrip("/").startswith(root + "/migrakit/"):
        raise ValueError(f"{path} is not a run folder of {root}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_database(spark: SparkSession, name: str) -> None:
    """Drops a run's database with its views and external registrations."""
    spark.sql(f"DROP DATABASE IF EXISTS `{name.replace('`', '``')}` CASCADE")
