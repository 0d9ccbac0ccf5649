"""Histograms as DataFrames: long form (names, bucket, entry, n) for whole numbers, (names, slot, n) for floats.

A histogram is a count by slot, so it plans as a partial and a final aggregate around one exchange, and what
is exchanged is bounded by the slots of each name, not by the observations. Merging is adding counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.slots import BUCKETS, ENTRIES, float_slot, int_slot, lower, valid_float, valid_int

INT_SLOT = ("bucket", "entry")
FLOAT_SLOT = ("slot",)


def build_int(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The histogram of each `by`. Null values and values outside [0, 2^63 - 65] are dropped before they are slotted."""
    bucket, entry = int_slot(F.col(value))
    return df.where(valid_int(F.col(value))).select(*by, bucket.alias("bucket"), entry.alias("entry")).groupBy(*by, *INT_SLOT).agg(F.count("*").alias("n"))


def build_float(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The float histogram of each `by`. Null, NaN and infinite values are dropped."""
    return df.where(valid_float(F.col(value))).select(*by, float_slot(F.col(value)).alias("slot")).groupBy(*by, *FLOAT_SLOT).agg(F.count("*").alias("n"))


def merge(*hists: DataFrame) -> DataFrame:
    """The histogram of all observations of several: counts of equal names and slots added."""
    names = [c for c in hists[0].columns if c != "n"]
    return reduce(DataFrame.unionByName, hists).groupBy(*names).agg(F.sum("n").alias("n"))


def left_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left with right's other columns, by equal values of `on`; nulls are equal."""
    named = right.select(*(F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on))
    return left.join(named, same, "left").drop(*(f"_on_{c}" for c in on))


def to_arrays(hist: DataFrame, by: list[str]) -> DataFrame:
    """One row for each name: slots as an array of structs in slot order. At most 3,648 (or 32,768) entries."""
    rest = [c for c in hist.columns if c not in by]
    return hist.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("slots"))


def from_arrays(arrays: DataFrame, by: list[str]) -> DataFrame:
    return arrays.select(*by, F.explode("slots").alias("s")).select(*by, "s.*")


def bucket_sums(hist: DataFrame, by: list[str]) -> DataFrame:
    return hist.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def bitmap(hist: DataFrame, by: list[str]) -> DataFrame:
    """(by, bucket, bits) for all 64 rows of the bitmap of each name: 64 characters 0 or 1, one for each entry."""
    full = hist.groupBy(*by, "bucket").agg(F.collect_set("entry").alias("held"))
    rows = hist.select(*by).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(63))))
    every = F.sequence(F.lit(0), F.lit(ENTRIES - 1))
    bits = F.array_join(F.transform(every, lambda i: F.when(F.array_contains(F.coalesce("held", F.array().cast("array<int>")), i), "1").otherwise("0")), "")
    return rows.join(full, [*by, "bucket"], "left").select(*by, "bucket", bits.alias("bits"))


def dump(hist: DataFrame, by: list[str]) -> DataFrame:
    """A line `lower:count` for each slot that holds anything."""
    return hist.select(*by, F.concat_ws(":", lower(F.col("bucket"), F.col("entry")).cast("string"), F.col("n").cast("string")).alias("line"))


def slot_count() -> int:
    return BUCKETS * ENTRIES
