"""Bitwise operators and physical representation of integers and floats.

The bits of 128-bit integers are BINARY(16), big endian, since DECIMAL(38, 0) does not
hold them all: `to_bits` gives them, `from_bits` takes them back where the value has 38
digits at most and fails otherwise, and `binary_op` works on them.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sonolith.functions.numtypes import Num, num
from sonolith.functions.scalar import fit

_2_64 = "18446744073709551616"


def _dec(x: str) -> Column:
    return F.lit(x).cast("decimal(38,0)")


def _as_signed(x: Column, t: Num) -> Column:
    """A BIGINT with the same low bits."""
    if t.bits == 128:
        raise ValueError("128-bit values have bit operators on BINARY(16) only: see binary_op")
    if t.kind == "u" and t.bits == 64:
        return F.when(x >= _dec("9223372036854775808"), x.cast("decimal(38,0)") - _dec(_2_64)).otherwise(x).cast("bigint")
    return x.cast("bigint")


def _back(x: Column, t: Num) -> Column:
    """The low bits of a BIGINT as t."""
    if t.kind == "i" and t.bits == 64:
        return x
    if t.kind == "u" and t.bits == 64:
        wide = x.cast("decimal(38,0)")
        return F.when(x < 0, wide + _dec(_2_64)).otherwise(wide).cast(t.spark)
    return fit(x, t, "wrap")


def bit_not(x: Column, t) -> Column:
    return _back(F.bitwise_not(_as_signed(x, num(t))), num(t))


def bit_and(a: Column, b: Column, t) -> Column:
    t = num(t)
    return _back(_as_signed(a, t).bitwiseAND(_as_signed(b, t)), t)


def bit_or(a: Column, b: Column, t) -> Column:
    t = num(t)
    return _back(_as_signed(a, t).bitwiseOR(_as_signed(b, t)), t)


def bit_xor(a: Column, b: Column, t) -> Column:
    t = num(t)
    return _back(_as_signed(a, t).bitwiseXOR(_as_signed(b, t)), t)


def _count(n: Column, t: Num) -> Column:
    """The shift count; at the type's width or beyond, shifts fail."""
    return F.when(n.isNull() | n.between(0, t.bits - 1), n).otherwise(F.raise_error(F.lit(f"shift beyond {t.bits} bits"))).cast("int")


def shift_left(x: Column, n: Column, t) -> Column:
    t = num(t)
    return _back(F.call_function("shiftleft", _as_signed(x, t), _count(n, t)), t)


def shift_right(x: Column, n: Column, t) -> Column:
    """Arithmetic for signed types, logical for unsigned ones."""
    t = num(t)
    name = "shiftrightunsigned" if t.kind == "u" and t.bits == 64 else "shiftright"
    return _back(F.call_function(name, _as_signed(x, t), _count(n, t)), t)


def binary_op(name: str):
    """and, or, xor, not, left or right on BINARY(16), big endian, as an Arrow UDF;
    shifts take the count as a second argument, and right is logical."""
    full = (1 << 128) - 1
    ops = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a ^ b, "not": lambda a, _: a ^ full, "left": lambda a, n: a << n & full, "right": lambda a, n: a >> n}
    op, shift = ops[name], name in ("left", "right")

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        number = lambda v: int.from_bytes(bytes(v), "big")
        return pd.Series([None if x is None or y is None else op(number(x), int(y) if shift else number(y)).to_bytes(16, "big") for x, y in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(run, "binary")


def _wide_bits(t: Num):
    """DECIMAL(38, 0) to the 16 bytes of its two's complement, as an Arrow UDF."""

    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else (int(v) & (1 << 128) - 1).to_bytes(16, "big") for v in x], dtype=object)

    return F.pandas_udf(run, "binary")


def _wide_value(t: Num):
    """The DECIMAL(38, 0) of 16 bytes, as an Arrow UDF."""

    def run(b: pd.Series) -> pd.Series:
        out = []
        for v in b:
            n = None if v is None else int.from_bytes(bytes(v), "big", signed=t.kind == "i")
            if n is not None and abs(n) >= 10**38:
                raise OverflowError("a 128-bit value has more than 38 digits")
            out.append(None if n is None else Decimal(n))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "decimal(38,0)")


def to_bits(x: Column, t) -> Column:
    """The unsigned bit view. NaN gives the canonical NaN of the JVM's raw view."""
    t = num(t)
    if t.bits == 128:
        return _wide_bits(t)(x.cast("decimal(38,0)"))
    if t.name == "f64":
        return _back(F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), x).cast("bigint"), num("u64"))
    if t.name == "f32":
        return _back(F.reflect(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), x).cast("bigint"), num("u32"))
    return fit(x.cast("decimal(38,0)"), t.unsigned, "wrap") if t.bits == 64 else fit(x.cast("bigint"), t.unsigned, "wrap")


def from_bits(b: Column, t) -> Column:
    t = num(t)
    if t.bits == 128:
        return _wide_value(t)(b)
    if t.name == "f64":
        return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), _as_signed(b, num("u64"))).cast("double")
    if t.name == "f32":
        return F.reflect(F.lit("java.lang.Float"), F.lit("intBitsToFloat"), fit(b.cast("bigint"), "i32", "wrap")).cast("float")
    return fit(b.cast("decimal(38,0)"), t, "wrap") if t.bits == 64 else fit(b.cast("bigint"), t, "wrap")


def bulk_bits(t="f64"):
    """to_bits of floats as an Arrow UDF with a NumPy view; keeps NaN payloads. BIGINT (signed view)."""
    wide, whole, out = (np.float64, np.int64, "bigint") if num(t).bits == 64 else (np.float32, np.int32, "int")

    def run(x: pd.Series) -> pd.Series:
        return pd.Series(x.to_numpy(wide).view(whole)).where(~x.isna().to_numpy() | np.isnan(x.to_numpy(wide)))

    return F.pandas_udf(run, out)


def _hex(x: Column, t: Num) -> Column:
    if t.bits == 128:
        return F.hex(to_bits(x, t))
    signed = _as_signed(to_bits(x, t), t.unsigned)
    return F.substring(F.lpad(F.hex(signed), 16, "0"), 17 - 2 * t.bytes, 2 * t.bytes)


def _reversed(h: Column, n: int) -> Column:
    return F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(n))])


def to_be_bytes(x: Column, t) -> Column:
    return F.unhex(_hex(x, num(t)))


def to_le_bytes(x: Column, t) -> Column:
    return F.unhex(_reversed(_hex(x, num(t)), num(t).bytes))


def from_be_bytes(b: Column, t) -> Column:
    t = num(t)
    if t.bits == 128:
        return from_bits(b, t)
    return from_bits(F.conv(F.hex(b), 16, 10).cast("decimal(20,0)" if t.bits == 64 else "bigint").cast(t.unsigned.spark), t)


def from_le_bytes(b: Column, t) -> Column:
    t = num(t)
    return from_be_bytes(F.unhex(_reversed(F.hex(b), t.bytes)), t)


#: Native order is fixed as little endian.
to_ne_bytes, from_ne_bytes = to_le_bytes, from_le_bytes
