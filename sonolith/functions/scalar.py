"""Scalar operators: arithmetic, order, sign, powers, logarithms, rounding.

Integer results have three overflow modes: `strict` raises, `try` gives NULL and
`wrap` takes the low bits. Each is stated in the expression, so it does not depend
on the session's ANSI setting. Floats follow IEEE 754: division by zero gives an
infinity or NaN, and NaN equals nothing. NULL in, NULL out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonolith.functions.numtypes import CONSTANTS, Num, num


def _nan() -> Column:
    return F.lit(float("nan"))


def _inf(sign: int = 1) -> Column:
    return F.lit(sign * float("inf"))


def _big(x: int) -> Column:
    return F.lit(str(x)).cast("decimal(38,0)")


def wide(x: Column, t: Num) -> Column:
    """x in a type that holds sums and products of t exactly."""
    return x.cast("bigint") if t.bits <= 32 else x.cast("decimal(38,0)")


def fit(r: Column, t: str | Num, mode: str = "strict") -> Column:
    """An exact wide integer as t."""
    t = num(t)
    if t.bits == 128:
        if mode == "wrap":
            raise ValueError("128-bit values are held in 38 digits and don't wrap")
        return r.cast(t.spark)
    small = t.bits <= 32
    low, high = (F.lit(t.low), F.lit(t.high)) if small else (_big(t.low), _big(t.high))
    if mode == "wrap":
        size = F.lit(1 << t.bits) if small else _big(1 << t.bits)
        up = F.pmod(r, size)
        return (F.when(up > high, up - size).otherwise(up) if t.kind == "i" else up).cast(t.spark)
    inside = r.between(low, high)
    if mode == "try":
        return F.when(inside, r).cast(t.spark)
    return F.when(r.isNull() | inside, r).otherwise(F.raise_error(F.concat(F.lit(f"{t.name} overflow: "), r.cast("string")))).cast(t.spark)


def _arith(a: Column, b: Column, t, mode: str, op) -> Column:
    t = num(t)
    if t.kind == "f":
        return op(a, b).cast(t.spark)
    return fit(op(wide(a, t), wide(b, t)), t, mode)


def add(a: Column, b: Column, t="f64", mode: str = "strict") -> Column:
    return _arith(a, b, t, mode, lambda x, y: x + y)


def sub(a: Column, b: Column, t="f64", mode: str = "strict") -> Column:
    return _arith(a, b, t, mode, lambda x, y: x - y)


def mul(a: Column, b: Column, t="f64", mode: str = "strict") -> Column:
    t = num(t)
    if t.kind == "u" and t.bits == 64:
        # Two halves keep each product within 38 digits.
        a, b, half = a.cast("decimal(38,0)"), b.cast("decimal(38,0)"), _big(1 << 32)
        high = F.floor(a / half).cast("decimal(20,0)")
        low = (a - high * half).cast("decimal(20,0)")
        if mode == "wrap":
            top = F.pmod((high * b.cast("decimal(20,0)")).cast("decimal(38,0)"), half)
            return F.pmod((low * b.cast("decimal(20,0)")).cast("decimal(38,0)") + top * half, _big(1 << 64)).cast(t.spark)
        exact = F.when((a == 0) | (b <= F.floor(_big(num(t).high) / F.when(a != 0, a))), (a.cast("decimal(20,0)") * b.cast("decimal(20,0)")).cast("decimal(38,0)"))
        if mode == "try":
            return F.when(exact <= _big(t.high), exact).cast(t.spark)
        return F.when(a.isNull() | b.isNull() | (exact <= _big(t.high)), exact).otherwise(F.raise_error(F.lit("u64 overflow"))).cast(t.spark)
    if (t.kind, t.bits) in (("i", 64), ("u", 32)):
        return fit((a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast("decimal(38,0)"), t, mode)
    return _arith(a, b, t, mode, lambda x, y: x * y)


def div(a: Column, b: Column, t="f64", mode: str = "strict") -> Column:
    """Integers truncate towards zero and fail on 0; floats follow IEEE 754."""
    t = num(t)
    if t.kind == "f":
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), a.cast("double") * F.pow(b.cast("double"), F.lit(-1.0))).cast(t.spark)
    a, b = wide(a, t), wide(b, t)
    r = a - F.try_mod(a, b)
    quotient = F.try_divide(r, b) if t.bits > 32 else F.call_function("try_divide", r.cast("decimal(20,0)"), b.cast("decimal(20,0)"))
    whole = quotient.cast("decimal(38,0)") if t.bits > 32 else quotient.cast("bigint")
    if mode != "try":
        whole = F.when(b == 0, F.raise_error(F.lit("division by zero"))).otherwise(whole)
    return fit(whole, t, mode)


def rem(a: Column, b: Column, t="f64", mode: str = "strict") -> Column:
    """Sign of the dividend; float remainder by zero is NaN."""
    t = num(t)
    if t.kind == "f":
        return F.coalesce(F.try_mod(a, b), F.when(a.isNotNull() & b.isNotNull(), _nan())).cast(t.spark)
    r = F.try_mod(wide(a, t), wide(b, t)).cast(t.spark)
    return r if mode == "try" else F.when(b == 0, F.raise_error(F.lit("division by zero"))).otherwise(r)


def _nn(a: Column, t) -> Column:
    """Not NaN."""
    return ~F.isnan(a) if num(t).kind == "f" else F.lit(True)


def eq(a: Column, b: Column, t="f64") -> Column:
    return (a == b) & _nn(a, t)


def lt(a: Column, b: Column, t="f64") -> Column:
    return (a < b) & _nn(a, t) & _nn(b, t)


def le(a: Column, b: Column, t="f64") -> Column:
    return (a <= b) & _nn(a, t) & _nn(b, t)


def gt(a: Column, b: Column, t="f64") -> Column:
    return lt(b, a, t)


def ge(a: Column, b: Column, t="f64") -> Column:
    return le(b, a, t)


def zero(t) -> Column:
    return num(t).lit(0)


def one(t) -> Column:
    return num(t).lit(1)


def neg_one(t) -> Column:
    if num(t).kind == "u":
        raise ValueError("unsigned types have no -1")
    return num(t).lit(-1)


def is_zero(x: Column) -> Column:
    return x == 0


def is_one(x: Column) -> Column:
    return x == 1


def set_zero(x: Column, t) -> Column:
    return zero(t)


def set_one(x: Column, t) -> Column:
    return one(t)


def recip(x: Column, t="f64") -> Column:
    """Integers: 1 -> 1, -1 -> -1, other -> 0, and 0 fails. Floats: IEEE 754."""
    t = num(t)
    return div(one(t), x, t)


inverse = recip


def dismantle(x: Column, t="f64") -> Column:
    """The simpler base of a value: none for plain numbers, so a typed NULL."""
    return F.lit(None).cast(num(t).spark)


def minimum(a: Column, b: Column, t="f64") -> Column:
    """A NaN beside a number is ignored; NULL beside anything is NULL."""
    r = F.least(F.nanvl(a, b), F.nanvl(b, a)) if num(t).kind == "f" else F.least(a, b)
    return F.when(a.isNotNull() & b.isNotNull(), r)


def maximum(a: Column, b: Column, t="f64") -> Column:
    r = F.greatest(F.nanvl(a, b), F.nanvl(b, a)) if num(t).kind == "f" else F.greatest(a, b)
    return F.when(a.isNotNull() & b.isNotNull(), r)


def clamp(x: Column, low: Column, high: Column, t="f64") -> Column:
    """NaN stays; low > high fails."""
    bad = F.when(~(low <= high), F.raise_error(F.lit("clamp needs low <= high")).cast(num(t).spark))
    inner = F.when(x < low, low).when(x > high, high).otherwise(x)
    if num(t).kind == "f":
        inner = F.when(F.isnan(x), x).otherwise(inner)
    return F.coalesce(bad, inner)


def _minus(x: Column) -> Column:
    """The sign bit of a float (that of NaN is lost)."""
    return x.cast("string").like("-%")


def neg(x: Column, t="f64", mode: str = "strict") -> Column:
    t = num(t)
    return (-x).cast(t.spark) if t.kind == "f" else fit(-wide(x, t), t, mode)


def absolute(x: Column, t="f64", mode: str = "strict") -> Column:
    t = num(t)
    return F.abs(x).cast(t.spark) if t.kind == "f" else fit(F.abs(wide(x, t)), t, mode)


def signum(x: Column, t="f64") -> Column:
    """Floats: 1 for +0.0, -1 for -0.0, NaN for NaN."""
    t = num(t)
    if t.kind == "f":
        return F.when(x == 0, F.when(_minus(x), -1.0).otherwise(1.0)).otherwise(F.signum(x)).cast(t.spark)
    return F.when(x > 0, 1).when(x < 0, -1).when(x == 0, 0).cast(t.spark)


def is_positive(x: Column, t="f64") -> Column:
    return ~_minus(x) if num(t).kind == "f" else x > 0


def is_negative(x: Column, t="f64") -> Column:
    return _minus(x) if num(t).kind == "f" else x < 0


def sq(x: Column, t="f64", mode: str = "strict") -> Column:
    return mul(x, x, t, mode)


def sqrt(x: Column, t="f64") -> Column:
    """Integers: floor of the root, exact; negative integers fail. Floats: NaN below 0."""
    t = num(t)
    if t.kind == "f":
        return F.sqrt(x).cast(t.spark)
    n = x.cast("decimal(20,0)")
    r = F.floor(F.sqrt(x.cast("double"))).cast("decimal(19,0)")
    square = lambda v: (v.cast("decimal(19,0)") * v.cast("decimal(19,0)")).cast("decimal(38,0)")
    r = F.when(square(r) > n, r - 1).when(square(r + 1) <= n, r + 1).otherwise(r)
    return F.when(x < 0, F.raise_error(F.lit("square root of a negative integer"))).otherwise(r).cast(t.spark)


def power(x: Column, y: Column, t="f64", mode: str = "strict") -> Column:
    """Integers take a whole exponent from 0; floats follow IEEE 754."""
    t = num(t)
    if t.kind == "f":
        fixed = (x == 1) | ((x == -1) & (F.abs(y) == float("inf")))
        return F.when(fixed & x.isNotNull() & y.isNotNull(), 1.0).when(y == 0, 1.0).otherwise(F.pow(x, y)).cast(t.spark)
    return F.aggregate(F.array_repeat(x.cast(t.spark), y.cast("int")), one(t), lambda acc, v: mul(acc, v, t, mode))


def root(x: Column, n: Column, t="f64") -> Column:
    """x to 1/n: NaN for a negative x and n = 3, unlike a cube root."""
    return power(x.cast("double"), recip(n.cast("double"))).cast(num(t).spark)


def exp(x: Column, t="f64") -> Column:
    return F.exp(x).cast(num(t).spark)


def exp2(x: Column, t="f64") -> Column:
    return F.pow(F.lit(2.0), x).cast(num(t).spark)


def exp_m1(x: Column, t="f64") -> Column:
    return F.expm1(x).cast(num(t).spark)


def _logarithm(fn, x: Column, edge: float, t) -> Column:
    """-inf at the edge of the domain and NaN below, where Spark gives NULL."""
    return F.when(x > edge, fn(x)).when(x == edge, _inf(-1)).when(x < edge, _nan()).cast(num(t).spark)


def ln(x: Column, t="f64") -> Column:
    return _logarithm(F.ln, x, 0.0, t)


def log2(x: Column, t="f64") -> Column:
    return _logarithm(F.log2, x, 0.0, t)


def log10(x: Column, t="f64") -> Column:
    return _logarithm(F.log10, x, 0.0, t)


def ln_1p(x: Column, t="f64") -> Column:
    return _logarithm(F.log1p, x, -1.0, t)


def log(x: Column, base: Column, t="f64") -> Column:
    return div(ln(x), ln(base), t)


_WHOLE = 4503599627370496.0  # 2^52: from here on every double is whole


def trunc(x: Column, t="f64") -> Column:
    return F.when(F.abs(x) >= _WHOLE, x).otherwise(x - x % F.lit(1.0)).cast(num(t).spark)


def floor(x: Column, t="f64") -> Column:
    part = x % F.lit(1.0)
    return F.when(F.abs(x) >= _WHOLE, x).otherwise(x - part - F.when(part < 0, 1.0).otherwise(0.0)).cast(num(t).spark)


def ceil(x: Column, t="f64") -> Column:
    part = x % F.lit(1.0)
    return F.when(F.abs(x) >= _WHOLE, x).otherwise(x - part + F.when((part > 0) & ~F.isnan(part), 1.0).otherwise(0.0)).cast(num(t).spark)


def rounded(x: Column, t="f64") -> Column:
    """Half away from zero."""
    part = x % F.lit(1.0)
    away = F.when((F.abs(part) >= 0.5) & ~F.isnan(part), F.signum(part)).otherwise(0.0)
    return F.when(F.abs(x) >= _WHOLE, x).otherwise(x - part + away).cast(num(t).spark)


def fract(x: Column, t="f64") -> Column:
    return (x % F.lit(1.0)).cast(num(t).spark)


def constant(name: str, t="f64") -> Column:
    """A named constant of a float type (see FloatConstants): its floats in that type, its counts as integers."""
    value = getattr(CONSTANTS[num(t).name], name)
    return F.lit(value).cast(num(t).spark) if isinstance(value, float) else F.lit(value)
