"""Signals held as array columns. Use for short vectors; long series take the row form.

Pairs of unequal length raise LENGTH_MISMATCH with both lengths, before computing;
with try_ they give NULL. Sums accumulate in double. Empty signals reduce to NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonolith.functions import scalar as S


def build(*samples: Column) -> Column:
    return F.array(*samples)


def length(a: Column) -> Column:
    return F.size(a)


def view(a: Column, start, count) -> Column:
    """count samples from the zero-based start."""
    return F.slice(a, F.lit(start) + 1 if isinstance(start, int) else start + 1, F.lit(count) if isinstance(count, int) else count)


def resize(a: Column, n: int, fill: Column) -> Column:
    return F.concat(F.slice(a, 1, n), F.array_repeat(fill, F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def clear(a: Column) -> Column:
    return F.slice(a, 1, 0)


def append(a: Column, value: Column) -> Column:
    return F.array_append(a, value)


def digest(a: Column) -> Column:
    return F.xxhash64(a)


def strided(data: Column, index: list[Column], strides: list[Column]) -> Column:
    """The element of an N-D array in flat storage."""
    at = F.aggregate(F.zip_with(F.array(*index), F.array(*strides), lambda i, s: (i * s).cast("long")), F.lit(0).cast("long"), lambda acc, v: acc + v)
    return F.get(data, at.cast("int"))


def minimum(a: Column) -> Column:
    return F.array_min(a)


def maximum(a: Column) -> Column:
    return F.array_max(a)


def argmax(a: Column) -> Column:
    """Zero-based; ties go to the lowest index."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)) - 1)


def argmin(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.array_position(a, F.array_min(a)) - 1)


def _sum(a: Column, f=lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x.cast("double")))


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, _sum(a) / F.size(a))


def norm_l2(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.sqrt(_sum(a, lambda x: x * x)))


def norm_l1(a: Column) -> Column:
    return F.when(F.size(a) > 0, _sum(a, F.abs))


def norm_inf(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))


def _paired(a: Column, b: Column, result: Column, attempt: bool) -> Column:
    if attempt:
        return F.when(F.size(a) == F.size(b), result)
    text = F.concat(F.lit("LENGTH_MISMATCH: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    return F.when(a.isNull() | b.isNull() | (F.size(a) == F.size(b)), result).otherwise(F.raise_error(text))


def _pointwise(op):
    def run(a: Column, b: Column, attempt: bool = False) -> Column:
        return _paired(a, b, F.zip_with(a, b, op), attempt)

    return run


sig_add = _pointwise(lambda x, y: x + y)
sig_sub = _pointwise(lambda x, y: x - y)
sig_mul = _pointwise(lambda x, y: x * y)
sig_div = _pointwise(lambda x, y: S.div(x.cast("double"), y.cast("double")))


def inner(a: Column, b: Column, attempt: bool = False) -> Column:
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return _paired(a, b, F.when(F.size(a) > 0, F.aggregate(both, F.lit(0.0), lambda acc, v: acc + v)), attempt)


def angle(a: Column, b: Column, attempt: bool = False) -> Column:
    cos = S.div(inner(a, b, attempt), norm_l2(a) * norm_l2(b))
    return F.acos(F.when(F.isnan(cos), cos).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def project(a: Column, b: Column, attempt: bool = False) -> Column:
    """The part of a along b."""
    share = S.div(inner(a, b, attempt), inner(b, b))
    return F.transform(b, lambda x: x.cast("double") * share)


def scale(a: Column, s: Column, op: str) -> Column:
    """Each sample with one value: add, sub, mul or div."""
    ops = {"add": lambda x: x + s, "sub": lambda x: x - s, "mul": lambda x: x * s, "div": lambda x: S.div(x.cast("double"), s.cast("double"))}
    return F.transform(a, ops[op])


def negate(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def convolve(a: Column, b: Column, mode: str = "full") -> Column:
    """Linear convolution: full (n + m - 1), causal (first n) or same (centred n). Costs
    n * m steps a row: for short vectors; `rows.convolve` takes long signals."""
    n, m = F.size(a), F.size(b)
    at = lambda k: F.aggregate(F.sequence(F.greatest(F.lit(0), k - m + 1), F.least(k, n - 1)), F.lit(0.0), lambda acc, i: acc + F.get(a, i).cast("double") * F.get(b, k - i).cast("double"))
    full = F.when((n > 0) & (m > 0), F.transform(F.sequence(F.lit(0), n + m - 2), at)).otherwise(F.array().cast("array<double>"))
    if mode == "causal":
        return F.slice(full, 1, n)
    return F.slice(full, F.floor((m - 1) / 2).cast("int") + 1, n) if mode == "same" else full


def resample(a: Column, factor: float) -> Column:
    """floor(n * factor) samples by linear interpolation; the last sample holds."""
    n = F.floor(F.size(a) * factor).cast("int")

    def at(k: Column) -> Column:
        place = k / factor
        low = F.floor(place).cast("int")
        left = F.get(a, low).cast("double")
        right = F.coalesce(F.get(a, low + 1).cast("double"), left)
        return left + (right - left) * (place - low)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>"))


def diff(a: Column) -> Column:
    """Steps between neighbours, one fewer than samples (the row form has a null first)."""
    return F.when(F.size(a) > 1, F.zip_with(F.slice(a, 2, F.size(a)), F.slice(a, 1, F.size(a) - 1), lambda x, y: x - y)).otherwise(F.slice(a, 1, 0))


def running_sum(a: Column) -> Column:
    """Sums so far. Copies the array for each sample: for short vectors; `rows.running_sum` takes long signals."""
    start = F.array().cast("array<double>")
    return F.aggregate(a, start, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, F.get(acc, F.size(acc) - 1)).otherwise(0.0) + x.cast("double"))))


def broadcast_pair(a: Column, b: Column, policy: str, fill: Column | None = None) -> tuple[Column, Column]:
    """Both signals at the longer length: zeropad, fill, latch (hold the last) or tile (repeat)."""
    n = F.greatest(F.size(a), F.size(b))

    def grown(x: Column) -> Column:
        if policy == "tile":
            return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(x, i % F.size(x)))).otherwise(x)
        value = {"zeropad": F.lit(0.0), "fill": fill, "latch": F.get(x, F.size(x) - 1)}[policy]
        return F.concat(x, F.array_repeat(value, n - F.size(x)))

    return grown(a), grown(b)
