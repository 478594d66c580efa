"""Logical numeric types, the Spark types that hold them, bounds and constants.

Unsigned types live in the next wider signed type; 64-bit unsigned ones in
DECIMAL(20,0); 128-bit ones in DECIMAL(38,0), which holds values of up to 38 digits.
"""

from __future__ import annotations

import math
import struct
import sys
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Num:
    name: str
    kind: str  # i, u or f
    bits: int
    spark: str

    @property
    def bytes(self) -> int:
        return self.bits // 8

    @cached_property
    def low(self) -> int | float:
        return -FLOATS_MAX[self.bits] if self.kind == "f" else -(1 << (self.bits - 1)) if self.kind == "i" else 0

    @cached_property
    def high(self) -> int | float:
        return FLOATS_MAX[self.bits] if self.kind == "f" else (1 << (self.bits - (self.kind == "i"))) - 1

    @property
    def least_positive(self) -> int | float:
        """0 for integers; the smallest normal number for floats."""
        return 0 if self.kind != "f" else 2.0**-126 if self.bits == 32 else sys.float_info.min

    @property
    def sign_mask(self) -> int:
        return 1 << (self.bits - 1)

    @property
    def unsigned(self) -> Num:
        """The type of the bit view."""
        return TYPES[f"u{self.bits}"]

    def lit(self, value) -> Column:
        """A literal of this type; integers beyond BIGINT go through decimal text."""
        if self.kind == "f":
            return F.lit(float(value)).cast(self.spark)
        return F.lit(str(int(value))).cast(self.spark)


FLOATS_MAX = {32: (2 - 2.0**-23) * 2.0**127, 64: sys.float_info.max}
_HELD = {"i": {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint", 128: "decimal(38,0)"}, "u": {8: "smallint", 16: "int", 32: "bigint", 64: "decimal(20,0)", 128: "decimal(38,0)"}}
TYPES: dict[str, Num] = {f"{k}{b}": Num(f"{k}{b}", k, b, s) for k, by in _HELD.items() for b, s in by.items()}
TYPES |= {"isize": Num("isize", "i", 64, "bigint"), "usize": Num("usize", "u", 64, "decimal(20,0)"), "f32": Num("f32", "f", 32, "float"), "f64": Num("f64", "f", 64, "double")}


def num(t: str | Num) -> Num:
    return t if isinstance(t, Num) else TYPES[t]


@dataclass(frozen=True)
class FloatConstants:
    """The limits of a float type, and its circle constants narrowed to it."""

    significand_bits: int
    exponent_bits: int
    epsilon: float
    digits: int
    min_exp: int
    max_exp: int
    min_10_exp: int
    max_10_exp: int

    @property
    def mantissa_digits(self) -> int:
        return self.significand_bits + 1

    @property
    def significand_mask(self) -> int:
        return (1 << self.significand_bits) - 1

    @property
    def exponent_mask(self) -> int:
        return ((1 << self.exponent_bits) - 1) << self.significand_bits

    def _narrowed(self, x: float) -> float:
        return struct.unpack("<f", struct.pack("<f", x))[0] if self.significand_bits == 23 else x

    @property
    def pi(self) -> float:
        return self._narrowed(math.pi)

    @property
    def e(self) -> float:
        return self._narrowed(math.e)

    @property
    def tau(self) -> float:
        """Twice the type's own pi."""
        return 2 * self.pi

    nan, infinity, neg_infinity = math.nan, math.inf, -math.inf


CONSTANTS = {
    "f32": FloatConstants(23, 8, 2.0**-23, 6, -125, 128, -37, 38),
    "f64": FloatConstants(52, 11, sys.float_info.epsilon, 15, -1021, 1024, -307, 308),
}
