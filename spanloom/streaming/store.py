"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_LEFT: list[tuple[SparkSession, str]] = []
#: The folder of each local application that has none set.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs on this machine (tests), one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _OWN.get(context.applicationId) or tempfile.mkdtemp(prefix="spanloom-")
        _OWN[context.applicationId] = where
    return where.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder, deleted when the driver ends if not before."""
    path = f"{shared_dir(spark)}/spanloom/{what}-{uuid.uuid4().hex}"
    _LEFT.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    if (spark, path) in _LEFT:
        _LEFT.remove((spark, path))


@atexit.register
def _clear() -> None:
    for spark, path in list(_LEFT):
        try:
            remove(spark, path)
        except Exception:  # the session has ended before
            return
