"""Session construction and lineage cutting.

Lineage is cut by writing Parquet into the shared folder the cluster names in
``spark.checkpoint.dir``.  That setting is read from the session; a folder of
our own is set only when it is unset (local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE sizes shuffle partitions at run time and splits a skewed join
    # partition; scan splits stay at 128 MB
    "spark.sql.files.maxPartitionBytes": "128m",
    # broadcast only on measured sizes: static planning estimates an explode's
    # output at its input's size, so static auto-broadcast is off and AQE
    # broadcasts at run time when a shuffle stage is actually small
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # model selection runs thousands of small jobs: keep the driver's status
    # store bounded
    "spark.sql.ui.retainedExecutions": "100",
    "spark.ui.retainedJobs": "200",
    "spark.ui.retainedStages": "200",
    "spark.ui.retainedTasks": "10000",
}


def get_session(master: str | None = None, app: str = "aftershock",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Read from ``spark.checkpoint.dir``.  Where that is unset, a session on one
    machine (``local[n]``: tests, the benchmark) gets a fresh temp folder; any
    other session raises, since executors cannot see each other's folders.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="aftershock-ckpt-")  # one machine: the driver is the executor
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


_SHIPPING = Lock()


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once a context.

    The usual ``--py-files`` makes it unnecessary but does no harm.  Threads
    that need the package wait for the first of them to send it: Spark refuses
    a second file of the same name while the first is being copied.
    """
    sc = spark.sparkContext
    with _SHIPPING:
        if getattr(sc, "_aftershock_shipped", False):
            return
        package = os.path.dirname(os.path.abspath(__file__))
        if os.path.isdir(package):  # not when it already runs from such an archive
            name = os.path.join(tempfile.mkdtemp(prefix="aftershock-py-"), "aftershock.zip")
            with zipfile.ZipFile(name, "w") as archive:
                for folder, _, files in os.walk(package):
                    for file in sorted(files):
                        if file.endswith(".py"):
                            path = os.path.join(folder, file)
                            archive.write(path, os.path.relpath(path, os.path.dirname(package)))
            sc.addPyFile(name)
        sc._aftershock_shipped = True


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    A reliable lineage cut: a lost executor re-reads the written files instead
    of recomputing the whole upstream plan.  Files live under
    ``<spark.checkpoint.dir>/aftershock/<application id>/`` and can be removed
    with that folder once the application has finished.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark)
    # one folder per application: a finished job's intermediates go together
    app = spark.sparkContext.applicationId
    path = os.path.join(base, "aftershock", app, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
