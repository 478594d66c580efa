"""Signals held as rows (signal_id, idx, sample): parallel within a signal too.

Window functions over one signal run in one task. For signals of any length,
`haloed` cuts them into chunks that carry their neighbours' edges, and
`running_sum` adds chunk totals: no task then holds more than a chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonolith.operators.filters import walked

CHUNK = 1 << 16


def from_series(df: DataFrame, signal: str, order: list[str], sample: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Zero-based idx by the given order within each signal."""
    by = Window.partitionBy(signal).orderBy(*order)
    return df.select(F.col(signal).alias("signal_id"), (F.row_number().over(by) - 1).cast("long").alias("idx"), F.col(sample).alias("sample"), *keep)


def from_arrays(df: DataFrame, signal: str, samples: str) -> DataFrame:
    return df.select(F.col(signal).alias("signal_id"), F.posexplode(samples).alias("idx", "sample")).withColumn("idx", F.col("idx").cast("long"))


def to_arrays(rows: DataFrame) -> DataFrame:
    """One row per signal; a signal must fit one row."""
    held = F.array_sort(F.collect_list(F.struct("idx", "sample")))
    return rows.groupBy("signal_id").agg(F.transform(held, lambda x: x["sample"]).alias("samples"))


def reductions(rows: DataFrame) -> DataFrame:
    """min, max, argmin, argmax, mean, norms and length of each signal, in one
    aggregation. NaN is above all numbers; ties go to the lowest index."""
    x = F.col("sample").cast("double")
    return rows.groupBy("signal_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("sample").alias("min"),
        F.max("sample").alias("max"),
        F.min_by("idx", F.when(F.col("sample").isNotNull(), F.struct("sample", "idx"))).alias("argmin"),
        F.max_by("idx", F.when(F.col("sample").isNotNull(), F.struct(F.col("sample"), -F.col("idx")))).alias("argmax"),
        F.avg(x).alias("mean"),
        F.sqrt(F.sum(x * x)).alias("norm_l2"),
        F.sum(F.abs(x)).alias("norm_l1"),
        F.max(F.abs(x)).alias("norm_inf"),
    )


def pointwise(a: DataFrame, b: DataFrame, op) -> DataFrame:
    """op(a, b) at each index; unequal lengths raise, before any value is given."""
    joined = a.select("signal_id", "idx", F.col("sample").alias("a"), F.lit(True).alias("has_a")).join(b.select("signal_id", "idx", F.col("sample").alias("b"), F.lit(True).alias("has_b")), ["signal_id", "idx"], "full")
    whole = F.col("has_a").isNotNull() & F.col("has_b").isNotNull()
    return joined.select("signal_id", "idx", F.when(whole, op(F.col("a"), F.col("b"))).otherwise(F.raise_error(F.concat(F.lit("LENGTH_MISMATCH in signal "), F.col("signal_id").cast("string")))).alias("sample"))


def inner(a: DataFrame, b: DataFrame) -> DataFrame:
    return pointwise(a, b, lambda x, y: x * y).groupBy("signal_id").agg(F.sum("sample").alias("inner"))


def _products(a: DataFrame, b: DataFrame) -> DataFrame:
    """signal_id, ab, aa, bb: inner products, in one pass over both; unequal lengths raise."""
    both = pointwise(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))).select("signal_id", "sample.*")
    x, y = F.col("x"), F.col("y")
    return both.groupBy("signal_id").agg(F.sum(x * y).alias("ab"), F.sum(x * x).alias("aa"), F.sum(y * y).alias("bb"))


def angle(a: DataFrame, b: DataFrame) -> DataFrame:
    """The angle of the signals of one id, NULL where one is zero."""
    size = F.sqrt("aa") * F.sqrt("bb")
    cosine = F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("ab") / size)))
    return _products(a, b).select("signal_id", F.acos(cosine).alias("angle"))


def project(a: DataFrame, b: DataFrame) -> DataFrame:
    """The part of a along b; NULL samples where b is zero."""
    share = _products(a, b).select("signal_id", F.when(F.col("bb") > 0, F.col("ab") / F.col("bb")).alias("share"))
    return b.select("signal_id", "idx", "sample").join(share, "signal_id").select("signal_id", "idx", (F.col("sample") * F.col("share")).alias("sample"))


def _latched(rows: DataFrame, names: tuple[str, ...], chunk: int) -> DataFrame:
    """Missing samples hold the one before: within a chunk, or the last of earlier chunks."""
    held = rows.withColumn("chunk", F.floor(F.col("idx") / chunk))
    ends = held.groupBy("signal_id", "chunk").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("idx"))).alias(c) for c in names])
    earlier = Window.partitionBy("signal_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("signal_id", "chunk", *[F.last(c, ignorenulls=True).over(earlier).alias(f"{c}_start") for c in names])
    # A chunk's start goes before its rows, so that no row needs a join.
    marks = starts.select("signal_id", "chunk", F.lit(-1).cast("long").alias("idx"), *[F.col(f"{c}_start").alias(c) for c in names])
    by = Window.partitionBy("signal_id", "chunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    each = held.select("signal_id", "chunk", "idx", *names).unionByName(marks)
    return each.select("signal_id", "idx", *[F.last(c, ignorenulls=True).over(by).alias(c) for c in names]).where("idx >= 0")


def broadcast_join(a: DataFrame, b: DataFrame, policy: str, fill: float = 0.0, chunk: int = CHUNK) -> DataFrame:
    """signal_id, idx, a, b at the longer length, by zeropad, fill, latch or tile."""
    a, b = (x.select("signal_id", "idx", F.col("sample").alias(n)) for x, n in ((a, "a"), (b, "b")))
    if policy == "tile":
        count = lambda x, n: x.groupBy("signal_id").agg(F.count(F.lit(1)).alias(n))
        both = a.select("signal_id", "idx").union(b.select("signal_id", "idx")).distinct()
        both = both.join(count(a, "n_a"), "signal_id").join(count(b, "n_b"), "signal_id")
        both = both.withColumn("at_a", F.col("idx") % F.col("n_a")).withColumn("at_b", F.col("idx") % F.col("n_b"))
        both = both.join(a.withColumnRenamed("idx", "at_a"), ["signal_id", "at_a"]).join(b.withColumnRenamed("idx", "at_b"), ["signal_id", "at_b"])
        return both.select("signal_id", "idx", "a", "b")
    joined = a.join(b, ["signal_id", "idx"], "full")
    if policy == "latch":
        return _latched(joined, ("a", "b"), chunk)
    value = F.lit(0.0 if policy == "zeropad" else fill)
    return joined.select("signal_id", "idx", F.coalesce("a", value).alias("a"), F.coalesce("b", value).alias("b"))


def haloed(rows: DataFrame, before: int, after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """rows dealt to chunks of a signal, each with the samples `before` and `after` it
    (own = false), from as many chunks as these reach into. Windows by (signal_id,
    chunk) then see what they need; a chunk shorter than its edges is repeated often."""
    at = F.floor(F.col("idx") / chunk)
    last = at if not before else F.floor((F.col("idx") + before) / chunk)
    first = at if not after else F.greatest(F.lit(0), F.floor((F.col("idx") - after) / chunk))
    return rows.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn("own", F.col("chunk") == at)


def fir(rows: DataFrame, taps: list[float], chunk: int = CHUNK) -> DataFrame:
    """Causal filter: taps[0] * x[i] + taps[1] * x[i-1] + ...; samples before the start are 0."""
    by = Window.partitionBy("signal_id", "chunk").orderBy("idx")
    x = F.col("sample")
    terms = [F.lit(float(c)) * (x if k == 0 else F.coalesce(F.lag(x, k).over(by), F.lit(0.0))) for k, c in enumerate(taps)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return haloed(rows, len(taps) - 1, chunk=chunk).withColumn("sample", total).where("own").drop("chunk", "own")


def convolve(rows: DataFrame, taps: list[float], chunk: int = CHUNK) -> DataFrame:
    """Full linear convolution with a kernel of any length: each chunk is convolved by
    itself, many short ones in a call, and where the results overlap they are added."""
    weights = np.array(taps, float)
    more = len(weights) - 1

    def run(part: pd.DataFrame, spans: list[tuple[int, int]]) -> pd.DataFrame:
        lo, hi = np.array(spans, np.int64).T
        # Behind each chunk stand as many zeros as its result is longer than it.
        sizes = hi - lo + more
        first = np.cumsum(sizes) - sizes
        spread = np.zeros(int(sizes.sum()))
        spread[np.arange(len(part)) + np.repeat(np.arange(len(lo)) * more, hi - lo)] = part["sample"].to_numpy(float)
        idx = np.arange(len(spread)) + np.repeat(part["idx"].to_numpy(np.int64)[lo] - first, sizes)
        if np.isfinite(spread).all():
            got = np.convolve(spread, weights)[: len(spread)]
        else:  # an infinite sample times a zero between chunks would spread to others
            got = np.concatenate([np.convolve(spread[k : k + n - more], weights) for k, n in zip(first, sizes, strict=True)])
        return pd.DataFrame({"signal_id": part["signal_id"].to_numpy()[np.repeat(lo, sizes)], "idx": idx, "sample": got})

    held = rows.select("signal_id", "idx", F.col("sample").cast("double"), F.floor(F.col("idx") / chunk).alias("chunk"))
    each = walked(held, ["signal_id", "chunk"], "idx", run, "signal_id long, idx long, sample double")
    return each.groupBy("signal_id", "idx").agg(F.sum("sample").alias("sample"))


def diff(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """x[i] - x[i-1]; NULL at the start."""
    by = Window.partitionBy("signal_id", "chunk").orderBy("idx")
    return haloed(rows, 1, chunk=chunk).withColumn("sample", F.col("sample") - F.lag("sample", 1).over(by)).where("own").drop("chunk", "own")


def running_sum(rows: DataFrame, chunk: int = CHUNK, exact: str | None = None) -> DataFrame:
    """Sum of all samples so far. exact: a decimal type in which to add, for equal results in any order."""
    x = F.col("sample").cast(exact) if exact else F.col("sample").cast("double")
    held = rows.withColumn("chunk", F.floor(F.col("idx") / chunk))
    totals = held.groupBy("signal_id", "chunk").agg(F.sum(x).alias("total"))
    earlier = Window.partitionBy("signal_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("signal_id", "chunk", F.sum("total").over(earlier).alias("start"))
    by = Window.partitionBy("signal_id", "chunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast(exact) if exact else F.lit(0.0)
    return held.join(starts, ["signal_id", "chunk"]).withColumn("sample", (F.coalesce("start", zero) + F.sum(x).over(by)).cast("double")).drop("chunk", "start")


def decimate(rows: DataFrame, k: int) -> DataFrame:
    return rows.where(F.col("idx") % k == 0).withColumn("idx", (F.col("idx") / k).cast("long"))


def upsample(rows: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """k samples for each by linear interpolation; the last one holds."""
    by = Window.partitionBy("signal_id", "chunk").orderBy("idx")
    ahead = haloed(rows, 0, 1, chunk).withColumn("next", F.coalesce(F.lead("sample", 1).over(by), F.col("sample"))).where("own")
    steps = ahead.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return steps.select("signal_id", (F.col("idx") * k + F.col("j")).alias("idx"), (F.col("sample") + (F.col("next") - F.col("sample")) * (F.col("j") / k)).alias("sample"))


def resample(rows: DataFrame, factor: float, chunk: int = CHUNK) -> DataFrame:
    """floor(n * factor) samples by linear interpolation; each sample gives those up to
    its next neighbour, so no row and no task holds a signal."""
    ends = rows.groupBy("signal_id").agg(F.max("idx").alias("last"))
    ends = ends.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / chunk))))
    by = Window.partitionBy("signal_id", "chunk").orderBy("idx")
    ahead = haloed(rows, 0, 1, chunk).withColumn("next", F.coalesce(F.lead("sample", 1).over(by), F.col("sample"))).where("own")
    low = F.col("idx")
    # Rounding may move a place by one: a candidate belongs to the sample that its own place names.
    around = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor(low * factor) - 1), F.ceil((low + 1) * factor) + 1)
    each = ahead.join(ends, ["signal_id", "chunk"]).withColumn("at", F.explode(around))
    each = each.where((F.floor(F.col("at") / factor) == low) & (F.col("at") < F.floor((F.col("last") + 1) * factor)))
    return each.select("signal_id", F.col("at").alias("idx"), (F.col("sample") + (F.col("next") - F.col("sample")) * (F.col("at") / factor - low)).alias("sample"))
