"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

# What every job of this library relies on. Anything about the size of the cluster
# (executors, memory, shuffle partitions) is left to the submitter.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Fetching the few songs of a result names their ids to the scan, one by one.
    "spark.sql.parquet.pushdown.inFilterThreshold": "32768",
}


def build_session(app: str = "cantera", master: str | None = None, **extra: str) -> SparkSession:
    """A session with `SETTINGS`; keys of `extra` use `__` where Spark uses a dot."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: `spark.checkpoint.dir` of the session.

    Only a local session without the setting gets a temporary folder of its own; a
    cluster must name one, because a machine-local folder is lost with its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        # One machine only: `local-cluster` has executors of its own, like any cluster.
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cantera-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to yet."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _work.add(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything has been written at `path`."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


_work: set[str] = set()


def remove_work(spark: SparkSession) -> None:
    """Delete what was written under `new_path`; for when no result that reads it is needed any more."""
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for path in sorted(_work):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(configuration).delete(place, True)
    _work.clear()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application.

    Only needed where it is neither installed on the machines nor submitted with the job.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        archive = f"{tempfile.mkdtemp(prefix='cantera-')}/{package.name}"
        context.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))
        _shipped.add(context.applicationId)
