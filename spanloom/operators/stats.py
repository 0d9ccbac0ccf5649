"""Queries of histograms. Each takes the long form and the names it is kept by, and returns a row for each name.

Names that have no observations appear if `names` lists them: total and sums 0, quantile the largest value (NaN
for floats), CDF NaN. Windows run over a name's slots, at most 3,648 or 32,768 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.slots import MAX_INT, float_lower, float_middle, float_slot, int_slot, lower, middle, upper
from .hist import FLOAT_SLOT, INT_SLOT, left_join

NAN = float("nan")


def _is_float(hist: DataFrame) -> bool:
    return "slot" in hist.columns


def _slot(hist: DataFrame) -> tuple[str, ...]:
    return FLOAT_SLOT if _is_float(hist) else INT_SLOT


def _middle(hist: DataFrame) -> Column:
    return float_middle(F.col("slot")) if _is_float(hist) else middle(F.col("bucket"), F.col("entry"))


def _with_names(out: DataFrame, names: DataFrame | None, by: list[str], fill: dict) -> DataFrame:
    if names is None:
        return out
    out = left_join(names.select(*by).distinct(), out, by)
    return out.select(*by, *(F.coalesce(c, F.lit(fill[c])).alias(c) for c in out.columns if c not in by))


def total(hist: DataFrame, by: list[str], names: DataFrame | None = None) -> DataFrame:
    return _with_names(hist.groupBy(*by).agg(F.sum("n").alias("total")), names, by, {"total": 0})


def moments(hist: DataFrame, by: list[str], names: DataFrame | None = None, strict_parity: bool = False) -> DataFrame:
    """total, sum, average and variance of each name, from the middles of the slots.

    The variance is that of the population for whole numbers, of the sample for floats (0 for one
    observation). It sums squared distances from the average in a second pass over the slots, for
    squares of large values would cancel. With strict_parity, a float variance is NaN where the first slot of
    the first leaf of 32 is empty and there is more than one observation, as in a fold that divides 0 by 0.
    """
    rows = hist.withColumn("x", _middle(hist))
    part = W.partitionBy(*by)
    rows = rows.withColumn("total", F.sum("n").over(part)).withColumn("sum", F.sum(F.col("n") * F.col("x")).over(part))
    far = F.col("x") - F.col("sum") / F.col("total")
    less = 1 if _is_float(hist) else 0
    first = [F.min("slot").alias("first")] if _is_float(hist) else []
    out = rows.groupBy(*by).agg(F.first("total").alias("total"), F.first("sum").alias("sum"), F.sum(F.col("n") * far * far).alias("squares"), *first)
    variance = F.when(F.col("total") > less, F.col("squares") / F.when(F.col("total") > less, F.col("total") - less)).otherwise(0.0)
    if strict_parity and _is_float(hist):
        variance = F.when((F.pmod("first", F.lit(32)) != 0) & (F.col("total") > 1), F.lit(NAN)).otherwise(variance)
    out = out.select(*by, "total", "sum", (F.col("sum") / F.col("total")).alias("average"), variance.alias("variance"))
    return _with_names(out, names, by, {"total": 0, "sum": 0.0, "average": 0.0, "variance": 0.0})


def quantiles(hist: DataFrame, by: list[str], qs: list[float], names: DataFrame | None = None) -> DataFrame:
    """(by, q, value): the slot where the count reaches trunc(q * total + 0.5); its middle, or for floats its lowest value.

    At a count of 0 it is the first entry of the first bucket (or leaf of 32 slots) that holds anything. q beyond the observations, and
    names without any, give 9223372036854775743, or NaN for floats.
    """
    slot = _slot(hist)
    order = W.partitionBy(*by).orderBy(*slot).rowsBetween(W.unboundedPreceding, 0)
    rows = hist.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(W.partitionBy(*by)))
    rows = rows.withColumn("q", F.explode(F.array(*map(F.lit, map(float, qs)))))
    rows = rows.withColumn("wanted", F.floor(F.col("q") * F.col("total") + F.lit(0.5)))
    at = F.min(F.when(F.col("upto") >= F.col("wanted"), F.struct(*slot))).alias("at")
    if _is_float(hist):
        start = (F.min("slot") - F.pmod(F.min("slot"), F.lit(32))).alias("start")
        found = rows.groupBy(*by, "q").agg(at, start, F.first("wanted").alias("wanted"))
        value = float_lower(F.when(F.col("wanted") <= 0, F.col("start")).otherwise(F.col("at.slot"))).cast("float")
        empty = F.lit(NAN).cast("float")
    else:
        found = rows.groupBy(*by, "q").agg(at, F.min("bucket").alias("start"), F.first("wanted").alias("wanted"))
        zero = F.col("wanted") <= 0
        bucket, entry = F.when(zero, F.col("start")).otherwise(F.col("at.bucket")), F.when(zero, 0).otherwise(F.col("at.entry"))
        # trunc(middle + 0.5), in whole numbers: half of a width less one is .5 but for width 1
        width = F.call_function("shiftleft", F.lit(1).cast("long"), bucket)
        value = F.floor(((width - 1) * 64).cast("double") + (width - 1).cast("double") / F.lit(2.0) + F.lit(0.5) + F.call_function("shiftleft", entry.cast("long"), bucket).cast("double"))
        empty = F.lit(MAX_INT)
    out = found.select(*by, "q", F.coalesce(value, empty).alias("value"))
    if names is not None:
        every = names.select(*by).distinct().withColumn("q", F.explode(F.array(*map(F.lit, map(float, qs)))))
        out = left_join(every, out, [*by, "q"]).select(*by, "q", F.coalesce("value", empty).alias("value"))
    return out


def cdf(hist: DataFrame, by: list[str], values: list[float], names: DataFrame | None = None) -> DataFrame:
    """(by, v, p): the part of the observations in slots up to that of v, all of it included. Whole numbers outside the valid range give 1."""
    rows = hist.withColumn("v", F.explode(F.array(*(F.lit(v).cast("float" if _is_float(hist) else "long") for v in values))))
    if _is_float(hist):
        below = F.col("slot") <= float_slot(F.col("v"))
    else:
        valid = F.col("v").between(0, MAX_INT)
        bucket, entry = int_slot(F.when(valid, F.col("v")).otherwise(0))
        below = ~valid | (F.col("bucket") < bucket) | ((F.col("bucket") == bucket) & (F.col("entry") <= entry))
    out = rows.groupBy(*by, "v").agg((F.sum(F.when(below, F.col("n")).otherwise(0)) / F.sum("n")).alias("p"))
    if names is not None:
        every = names.select(*by).distinct().withColumn("v", F.explode(F.array(*map(F.lit, values)))).withColumn("v", F.col("v").cast(out.schema["v"].dataType))
        out = left_join(every, out, [*by, "v"]).withColumn("p", F.coalesce("p", F.lit(NAN)))
    return out


def percentiles(hist: DataFrame, by: list[str]) -> DataFrame:
    """(by, value, count, total): the walk along the CDF, from (lowest value of the first slot, 0) through the highest value of each slot and the count up to it."""
    order = W.partitionBy(*by).orderBy(*INT_SLOT).rowsBetween(W.unboundedPreceding, 0)
    rows = hist.withColumn("count", F.sum("n").over(order)).withColumn("total", F.sum("n").over(W.partitionBy(*by)))
    step = F.struct(upper(F.col("bucket"), F.col("entry")).alias("value"), F.col("count"))
    begin = F.struct(lower(F.col("bucket"), F.col("entry")).alias("value"), F.lit(0).cast("long").alias("count"))
    steps = F.when(F.col("count") == F.col("n"), F.array(begin, step)).otherwise(F.array(step))  # only the first slot's count is its own
    return rows.withColumn("step", F.explode(steps)).select(*by, "step.value", "step.count", "total")
