"""Spans: rows (name, start_ts, duration_ns, kind), from tables, or from timers on the driver."""

from __future__ import annotations

import functools
import inspect
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.kinds import error_kind

SCHEMA = "name string, start_ns bigint, stop_ns bigint, err_name string, err_msg string"


def spans(rows: DataFrame, enabled: bool = True) -> DataFrame:
    """(name, start_ns, duration_ns, kind) of rows in SCHEMA. Disabled, there are none."""
    out = rows.select("name", "start_ns", (F.col("stop_ns") - F.col("start_ns")).alias("duration_ns"), error_kind(F.col("err_name"), F.col("err_msg")).alias("kind"))
    return out if enabled else out.limit(0)


def observations(rows: DataFrame, name: str, value: str) -> DataFrame:
    """(name, duration_ns, kind) of plain values, without errors."""
    return rows.select(F.col(name).alias("name"), F.col(value).cast("long").alias("duration_ns"), F.lit("").alias("kind"))


class Timers:
    """Timers of driver code, as rows for createDataFrame. Disabled ones record nothing."""

    def __init__(self, enabled: bool = True):
        self.enabled, self.rows = enabled, []

    @contextmanager
    def start(self, name: str | None = None):
        """Times a block under a name, or under the function that it stands in."""
        name = name or inspect.stack()[2].function
        begin, err = time.monotonic_ns(), None
        try:
            yield
        except Exception as e:
            err = e
            raise
        finally:
            if self.enabled:
                self.rows.append((name, begin, time.monotonic_ns(), getattr(err, "kind_name", None), None if err is None else str(err)))

    def timed(self, function):
        """A function, each call of which is timed under its name, looked up once."""
        name = function.__qualname__

        @functools.wraps(function)
        def run(*args, **kwargs):
            with self.start(name):
                return function(*args, **kwargs)

        return run

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)
