"""Histograms over streams: a running snapshot, and windows that are emitted once and cleared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.hist import build_int
from .store import new_path


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """A stream of the table's files."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def snapshot(stream: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The histograms of all rows so far; for output mode complete."""
    return build_int(stream, value, by)


def collect(stream: DataFrame, value: str, by: list[str], ts: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, by, bucket, entry, n): each window's histograms, for output mode append: emitted once when the watermark has passed its end, then cleared. Rows later than that are dropped."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    held = build_int(timed.withColumn("_w", F.window("_ts", width)), value, ["_w", *by])
    return held.select(F.col("_w.start").alias("start"), *by, "bucket", "entry", "n")


def run_once(out: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """What a streaming DataFrame gives for all data there is now, as a table in the shared folder: each micro-batch writes its own part anew if it is repeated. In mode complete the last batch has all."""
    path = new_path(out.sparkSession, "stream")
    found = _table(out, out.schema, path, lambda df, n: df, mode, checkpoint)
    if mode == "complete":
        last = found.agg(F.max("batch").alias("last"))  # one row
        found = found.join(F.broadcast(last), F.col("batch") == F.col("last")).drop("last")
    return found.drop("batch")


def drained(stream: DataFrame, value: str, by: list[str], checkpoint: str | None = None) -> DataFrame:
    """(batch, by, bucket, entry, n): the histograms of each micro-batch of all data there is now. A row is in one batch only, so successive drains are disjoint and add up."""
    path = new_path(stream.sparkSession, "drained")
    schema = build_int(stream.sparkSession.createDataFrame([], stream.schema), value, by).schema
    return _table(stream, schema, path, lambda df, n: build_int(df, value, by), "append", checkpoint)


def drain(stream: DataFrame, value: str, by: list[str], write, checkpoint: str):
    """Starts a query that gives write(histograms, batch number) the histograms of each micro-batch: successive drains are disjoint."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: write(build_int(df, value, by), n)).start()


def _table(stream: DataFrame, schema: StructType, path: str, made: Callable[[DataFrame, int], DataFrame], mode: str, checkpoint: str | None) -> DataFrame:
    """made(rows, number) of each micro-batch, written below path, with the batch's number."""
    spark = stream.sparkSession
    spark.createDataFrame([], schema).write.parquet(f"{path}/batch=-1")  # there may be no batch
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or new_path(spark, "stream-state"))
    writer.foreachBatch(lambda df, n: made(df, n).write.mode("overwrite").parquet(f"{path}/batch={n}")).start().awaitTermination()
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
