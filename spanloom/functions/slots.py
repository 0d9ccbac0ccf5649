"""Slots: the fixed cells that observations are counted in, as expressions that stay inside generated code.

A whole number v has a slot (bucket, entry): with u = v + 64, bucket = bit length of u less 7, entry = the 6 bits of u
below its leading bit. A 32-bit float has the top 15 bits of its order-preserving bit pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The largest whole number with a slot, and the numbers of buckets and of entries in each.
MAX_INT = 9223372036854775743
BUCKETS = 57
ENTRIES = 64
#: The largest finite 32-bit float; the slot of +0.0.
MAX_FLOAT = 3.4028234663852886e38
ZERO_SLOT = 16384


def valid_int(v: Column) -> Column:
    return v.between(0, MAX_INT)


def valid_float(v: Column) -> Column:
    f = v.cast("float").cast("double")
    return ~F.isnan(f) & (F.abs(f) <= F.lit(MAX_FLOAT))


def int_slot(v: Column) -> tuple[Column, Column]:
    """(bucket, entry) of a valid whole number."""
    u = v.cast("long") + F.lit(64)
    # a double rounds large numbers up to a power of two at most, so half of u is compared as a whole number
    e = F.least(F.floor(F.log2(u)), F.lit(62)).cast("int")
    bits = F.when(_long_two(e) > u, e - 1).when(F.call_function("shiftright", u, e + 1) >= 1, e + 1).otherwise(e)
    bucket = bits - 6
    return bucket, (F.call_function("shiftright", u, bucket) - 64).cast("int")


def _long_two(bucket: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bucket)


def lower(bucket: Column, entry: Column) -> Column:
    """The smallest value of a slot."""
    return (_long_two(bucket) - 1) * 64 + F.call_function("shiftleft", entry.cast("long"), bucket)


def upper(bucket: Column, entry: Column) -> Column:
    """The largest value of a slot."""
    return lower(bucket, entry) + _long_two(bucket) - 1


def middle(bucket: Column, entry: Column) -> Column:
    """The middle of a slot, in double precision."""
    width = _long_two(bucket)
    return ((width - 1) * 64).cast("double") + (width - 1).cast("double") / F.lit(2.0) + F.call_function("shiftleft", entry.cast("long"), bucket).cast("double")


def float_slot(v: Column) -> Column:
    """The slot of a valid float, which is rounded to 32 bits first. -0.0 is below +0.0.

    The logarithm of a power of two may be off by a bit either way, but the next float below one is 2^-24 away: so a
    float made larger by 2^-40 of itself has the exponent that floor(log2) gives. All else is exact in double precision.
    """
    f = v.cast("float").cast("double")
    a = F.abs(f)
    least = 2.0**-126
    e = F.floor(F.log2(F.greatest(a, F.lit(least)) * (1 + 2.0**-40)))
    c = F.when(a >= least, F.floor((e + a / F.pow(F.lit(2.0), e) + 126.0) * 64.0)).otherwise(F.floor(a * (2.0**126) * 64.0)).cast("int")
    negative = F.when(a == 0.0, f.cast("string").startswith("-")).otherwise(f < 0)
    return F.when(negative, F.lit(ZERO_SLOT - 1) - c).otherwise(c + ZERO_SLOT)


def _float_at(slot: Column, positive: float, negative: float) -> Column:
    """A float of the slot, that far into it."""
    c = F.when(slot >= ZERO_SLOT, slot - ZERO_SLOT).otherwise(ZERO_SLOT - 1 - slot)
    e, m = F.floor(c / 64), F.pmod(c, F.lit(64))
    part = m / 64.0 + F.when(slot >= ZERO_SLOT, positive).otherwise(negative)
    a = F.when(e == 0, part * (2.0**-126)).otherwise((part + 1.0) * F.pow(F.lit(2.0), e - 127))
    return F.when(slot >= ZERO_SLOT, a).otherwise(-a)


def float_lower(slot: Column) -> Column:
    """The numerically smallest float of a slot, as double."""
    return _float_at(slot, 0.0, 1 / 64 - 2.0**-23)


def float_middle(slot: Column) -> Column:
    """The float in the middle of a slot, as double."""
    return _float_at(slot, 1 / 128, 1 / 128 - 2.0**-23)
