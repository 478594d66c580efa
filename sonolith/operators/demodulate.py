"""Demodulation of received signals: from the samples of a real carrier alone.

The quadrature part is the signal's Hilbert transform, by a windowed filter over chunks.
Amplitude is the size of both parts. Phase is their angle, unwrapped: steps of more than
half a turn are turns taken back or on, and their sum so far is a running sum over chunks.
The carrier's own phase at index 0 is estimated as the mean of what the unwrapped phase
has over the carrier's.

Defined results: as for `rows`: an index occurs once in a signal, from 0 on; within the
filter's half length of a signal's ends, and where the message is as fast as the carrier,
parts are inexact; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.operators import rows as R


def hilbert_taps(half: int) -> list[float]:
    """2 * half + 1 taps of a Hilbert transform, weighted by a Hamming window."""
    out = []
    for k in range(-half, half + 1):
        weight = 0.54 + 0.46 * math.cos(math.pi * k / half)
        out.append(2 / (math.pi * k) * weight if k % 2 else 0.0)
    return out


def analytic(rows: DataFrame, half: int = 32, chunk: int = R.CHUNK) -> DataFrame:
    """signal_id, idx, i (the samples) and q (their Hilbert transform)."""
    turned = R.convolve(rows.select("signal_id", "idx", "sample"), hilbert_taps(half), chunk)
    turned = turned.select("signal_id", (F.col("idx") - half).alias("idx"), F.col("sample").alias("q"))
    return rows.select("signal_id", "idx", F.col("sample").cast("double").alias("i")).join(turned, ["signal_id", "idx"])


def unwrapped(parts: DataFrame, chunk: int = R.CHUNK) -> DataFrame:
    """signal_id, idx, sample: the angle of (i, q) without jumps of a turn."""
    angle = parts.select("signal_id", "idx", F.atan2("q", "i").alias("sample"))
    step = R.diff(angle, chunk).select("signal_id", "idx", (-F.round(F.coalesce("sample", F.lit(0.0)) / (2 * math.pi))).alias("sample"))
    turns = R.running_sum(step, chunk).select("signal_id", "idx", F.col("sample").alias("turns"))
    return angle.join(turns, ["signal_id", "idx"]).select("signal_id", "idx", (F.col("sample") + 2 * math.pi * F.col("turns")).alias("sample"))


def am(rows: DataFrame, depth: float = 1.0, half: int = 32, chunk: int = R.CHUNK) -> DataFrame:
    """The message of (1 + depth * message) * carrier, whatever the carrier's phase."""
    size = F.sqrt(F.col("i") * F.col("i") + F.col("q") * F.col("q"))
    return analytic(rows, half, chunk).select("signal_id", "idx", ((size - 1) / depth).alias("sample"))


def pm(rows: DataFrame, omega: float, gain: float = 1.0, half: int = 32, chunk: int = R.CHUNK) -> DataFrame:
    """The message of cos(omega * idx + phase + gain * message), up to its mean: the carrier's
    phase and the mean message are one constant, which is estimated and taken away."""
    over = unwrapped(analytic(rows, half, chunk), chunk).withColumn("sample", F.col("sample") - omega * F.col("idx"))
    mean = over.groupBy("signal_id").agg(F.avg("sample").alias("phase"))
    return over.join(mean, "signal_id").select("signal_id", "idx", ((F.col("sample") - F.col("phase")) / gain).alias("sample"))


def fm(rows: DataFrame, omega: float, gain: float = 1.0, half: int = 32, chunk: int = R.CHUNK) -> DataFrame:
    """The message of cos(omega * idx + phase + gain * (sum of the message so far)); the first sample is null."""
    step = R.diff(unwrapped(analytic(rows, half, chunk), chunk), chunk)
    return step.select("signal_id", "idx", ((F.col("sample") - omega) / gain).alias("sample"))
