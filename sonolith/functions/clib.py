"""Exponentials and logarithms of the C library, and rounding by a power of ten.

The JVM's functions may differ from the C library's by one unit in the last place, and
SQL engines in C round a product with a power of ten where Spark rounds the shortest
decimal text. Where results must agree with such an engine to the last digit these take
the values of the same library, through Arrow.

Defined results: NULL gives NULL; logarithms are -inf at 0 and NaN below.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sonolith.functions import scalar as S


@F.arrow_udf(DoubleType())
def exp(x: pa.Array) -> pa.Array:
    return pc.exp(x)


@F.arrow_udf(DoubleType())
def exp2(x: pa.Array) -> pa.Array:
    return pc.power(2.0, x)


@F.arrow_udf(DoubleType())
def ln(x: pa.Array) -> pa.Array:
    return pc.ln(x)


@F.arrow_udf(DoubleType())
def log2(x: pa.Array) -> pa.Array:
    return pc.log2(x)


@F.arrow_udf(DoubleType())
def log10(x: pa.Array) -> pa.Array:
    return pc.log10(x)


def decimals(x: Column, digits: int) -> Column:
    """x rounded to digits behind the point, half away from zero; what overflows stays."""
    up = x * F.lit(10.0**digits)
    return F.when(F.abs(up) == float("inf"), x).otherwise(S.rounded(up) / F.lit(10.0**digits))
