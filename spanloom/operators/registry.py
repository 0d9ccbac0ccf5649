"""The registry: names with their histogram and error counts, read as a snapshot or drained by windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .hist import build_int


def errors_by_kind(spans: DataFrame, by: list[str]) -> DataFrame:
    """(by, kind, n) of the spans with an error, also of those whose duration no histogram holds."""
    return spans.where("kind <> ''").groupBy(*by, "kind").agg(F.count("*").alias("n"))


def snapshot(spans: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(name, total, errors): every name that a span or `names` mentions, with its observations and errors counted."""
    valid = F.col("duration_ns").between(0, 9223372036854775743)
    out = spans.groupBy("name").agg(F.count(F.when(valid, 1)).alias("total"), F.count(F.when(F.col("kind") != "", 1)).alias("errors"))
    if names is not None:
        zero = F.lit(0).cast("long")  # one scan of the spans, and null is a name like others
        out = out.unionByName(names.select("name", zero.alias("total"), zero.alias("errors"))).groupBy("name").agg(F.sum("total").alias("total"), F.sum("errors").alias("errors"))
    return out


def lookup(states: DataFrame, name: str) -> DataFrame:
    """The state of a name; no row if there is none."""
    return states.where(F.col("name") == name)


def first_states(states: DataFrame, n: int) -> DataFrame:
    """A scan that stops after n names, in order of name."""
    return states.orderBy("name").limit(n)


def collect(spans: DataFrame, width: str = "1 day") -> DataFrame:
    """(start, name, bucket, entry, n): the histograms drained at each end of a window of `width`; a span belongs to the window it starts in."""
    at = spans.withColumn("start", F.window("start_ts", width)["start"])
    return build_int(at, "duration_ns", ["start", "name"])


def kept(spans: DataFrame, width: str = "1 day") -> DataFrame:
    """The spans that end in the window they start in: one that spans a drain writes to a state that has been read, and is lost."""
    end = F.col("start_ts") + F.expr("make_dt_interval(0, 0, 0, cast(duration_ns / 1e9 as decimal(18, 6)))")
    return spans.where(F.window("start_ts", width)["end"] > end)
