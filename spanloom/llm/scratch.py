"""Tables written in the shared folder of the cluster, to cut lineage and to be read more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming.store import new_path, remove

__all__ = ["bounded", "drop", "new_path", "remove", "save"]

#: Bytes of an Arrow batch that goes to a Python worker, if the session asks for no less.
ARROW_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """From now on a Python worker gets Arrow batches of at most ARROW_BYTES, or one row: what it holds doesn't grow with the length of texts."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(_BATCH, str(ARROW_BYTES))


def save(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: an executor that is lost takes none of it along."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._spanloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what save(df) wrote, once nothing reads it any more."""
    if path := getattr(df, "_spanloom_path", None):
        remove(df.sparkSession, path)
