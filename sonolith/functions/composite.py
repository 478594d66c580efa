"""Complex numbers as STRUCT<re, im> and fixed-point numbers as DECIMAL(p, s)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonolith.functions.scalar import div


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def c_add(a: Column, b: Column) -> Column:
    return complex_of(a["re"] + b["re"], a["im"] + b["im"])


def c_sub(a: Column, b: Column) -> Column:
    return complex_of(a["re"] - b["re"], a["im"] - b["im"])


def c_mul(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def c_conj(a: Column) -> Column:
    return complex_of(a["re"], -a["im"])


def c_abs(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def c_arg(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def c_div(a: Column, b: Column) -> Column:
    n = b["re"] * b["re"] + b["im"] * b["im"]
    p = c_mul(a, c_conj(b))
    return complex_of(div(p["re"], n), div(p["im"], n))


def fixed(x: Column, digits: int, scale: int) -> Column:
    """x rounded half away from zero to DECIMAL(digits, scale); NULL where it does not fit."""
    return x.try_cast(f"decimal({digits},{scale})")
