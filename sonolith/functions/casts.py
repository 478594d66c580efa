"""Checked conversions between all numeric types: NULL where the value does not fit.

Floats truncate towards zero over the open range (MIN - 1, MAX + 1); NaN and
infinities fit no integer. Integers always convert to floats, rounded to nearest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonolith.functions.numtypes import TYPES, Num, num
from sonolith.functions.scalar import fit, trunc

_2_63 = 9223372036854775808.0


def _whole_to_decimal(x: Column) -> Column:
    """A whole double below 2^64 in size, exactly; a plain cast goes through decimal text."""
    held = lambda v: v.cast("bigint").cast("decimal(38,0)")
    big = F.lit("9223372036854775808").cast("decimal(38,0)")
    return F.when(x >= _2_63, held(x - _2_63) + big).when(x >= -_2_63, held(x))


def checked_cast(x: Column, src: str | Num, dst: str | Num) -> Column:
    src, dst = num(src), num(dst)
    if dst.kind == "f":
        # The optimizer makes of casts from an integer to float and on to double one that keeps all
        # digits; from a decimal it does not.
        wide = dst.bits == 32 and src.kind != "f" and 16 < src.bits <= 64
        return (x.cast("decimal(20,0)") if wide else x).cast(dst.spark)
    if src.kind != "f":
        if dst.bits == 128:
            return F.when(x >= 0, x.cast(dst.spark)) if dst.kind == "u" else x.cast(dst.spark)
        return fit(x.cast("decimal(38,0)"), dst, "try")
    d = x.cast("double")
    whole = trunc(d)
    if dst.bits == 128:
        # Beyond 2^64 a double is a whole multiple of 2^11; two parts keep it exact to 38 digits.
        step = 18446744073709551616.0
        high = trunc(d / step)
        low = d - high * step
        exact = _whole_to_decimal(trunc(high)) * F.lit("18446744073709551616").cast("decimal(20,0)") + _whole_to_decimal(trunc(low))
        small = F.abs(d) < 1e37
        return F.when(small & (d > (-1 if dst.kind == "u" else -1e38)), exact.cast(dst.spark))
    low_edge = float(dst.low) - 1 if dst.bits <= 32 else None
    above = d > low_edge if low_edge is not None else (d > -1.0 if dst.kind == "u" else d >= float(dst.low))
    inside = above & (d < float(dst.high + 1))
    value = whole.cast("bigint") if not (dst.kind == "u" and dst.bits == 64) else _whole_to_decimal(whole)
    return F.when(inside, value).cast(dst.spark)


def to(x: Column, src: str, dst: str) -> Column:
    return checked_cast(x, src, dst)


def from_(x: Column, dst: str, src: str) -> Column:
    """The same conversion, named from its target."""
    return checked_cast(x, src, dst)


#: All pairs, as (source, target).
PAIRS = [(a, b) for a in TYPES for b in TYPES]
