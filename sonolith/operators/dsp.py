"""Spectra, modulation, generators, windows and rate-aware pipelines."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonolith.operators import rows as R


def dft(rows: DataFrame, bins: int, n: int) -> DataFrame:
    """Bins 0 to bins - 1 of signals of n samples: one row becomes `bins` sums' terms, added map-side."""
    each = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    turn = 2 * math.pi * F.col("k") * F.col("idx") / n
    return each.groupBy("signal_id", "k").agg((F.sum(F.col("sample") * F.cos(turn)) + 0.0).alias("re"), (-F.sum(F.col("sample") * F.sin(turn)) + 0.0).alias("im"))


def frames(rows: DataFrame, n: int) -> DataFrame:
    """rows with `frame`, and idx counted from its start: consecutive frames of n samples."""
    return rows.select("signal_id", F.floor(F.col("idx") / n).cast("long").alias("frame"), (F.col("idx") % n).alias("idx"), "sample")


def framed_dft(rows: DataFrame, n: int) -> DataFrame:
    """All n bins of each frame of n samples, by sums; missing samples of the last frame are 0."""
    each = frames(rows, n).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    turn = 2 * math.pi * F.col("k") * F.col("idx") / n
    return each.groupBy("signal_id", "frame", "k").agg((F.sum(F.col("sample") * F.cos(turn)) + 0.0).alias("re"), (-F.sum(F.col("sample") * F.sin(turn)) + 0.0).alias("im"))


def framed_fft(rows: DataFrame, n: int) -> DataFrame:
    """All n bins of each frame of n samples by an FFT over gathered frames; missing samples of the last frame are 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.zeros((len(batch), n))
            for row, at, samples in zip(range(len(batch)), batch["at"], batch["samples"], strict=True):
                x[row, np.asarray(at, int)] = samples
            got = np.fft.fft(x, axis=1)
            yield pd.DataFrame({"signal_id": batch["signal_id"].repeat(n), "frame": batch["frame"].repeat(n), "k": np.tile(np.arange(n), len(batch)), "re": got.real.ravel(), "im": got.imag.ravel()})

    held = frames(rows, n).groupBy("signal_id", "frame").agg(F.collect_list(F.struct("idx", F.col("sample").cast("double").alias("sample"))).alias("x"))
    return held.select("signal_id", "frame", F.col("x.idx").alias("at"), F.col("x.sample").alias("samples")).mapInPandas(run, "signal_id long, frame long, k long, re double, im double")


def fft(rows: DataFrame) -> DataFrame:
    """All bins of each signal by an FFT, as a grouped Arrow function; a signal must fit one task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        got = np.fft.fft(part["sample"].to_numpy(float))
        return pd.DataFrame({"signal_id": part["signal_id"].iloc[0], "k": np.arange(len(got)), "re": got.real, "im": got.imag})

    return rows.select("signal_id", "idx", "sample").groupBy("signal_id").applyInPandas(run, "signal_id long, k long, re double, im double")


def inverse_dft(spectrum: DataFrame, n: int) -> DataFrame:
    """Real samples of full spectra of n bins."""
    each = spectrum.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    turn = 2 * math.pi * F.col("k") * F.col("idx") / n
    return each.groupBy("signal_id", F.col("idx").cast("long").alias("idx")).agg((F.sum(F.col("re") * F.cos(turn) - F.col("im") * F.sin(turn)) / n).alias("sample"))


def iq(i: Column, q: Column, omega: float, idx: Column) -> Column:
    """The carrier with in-phase and quadrature parts; AM, PM and FM are special cases."""
    return i * F.cos(F.lit(omega) * idx) - q * F.sin(F.lit(omega) * idx)


def am(sample: Column, omega: float, idx: Column, depth: float = 1.0) -> Column:
    return iq(1.0 + F.lit(depth) * sample, F.lit(0.0), omega, idx)


def pm(sample: Column, omega: float, idx: Column, gain: float = 1.0) -> Column:
    return iq(F.cos(F.lit(gain) * sample), F.sin(F.lit(gain) * sample), omega, idx)


def fm(running_sum: Column, omega: float, idx: Column, gain: float = 1.0) -> Column:
    """Phase modulation by the running sum of the signal."""
    return pm(running_sum, omega, idx, gain)


def iq_demodulate(rows: DataFrame, omega: float, taps: list[float], chunk: int = R.CHUNK) -> DataFrame:
    """In-phase and quadrature parts: mix down, then a causal low-pass filter."""
    x = F.col("sample")
    i = R.fir(rows.withColumn("sample", 2 * x * F.cos(omega * F.col("idx"))), taps, chunk)
    q = R.fir(rows.withColumn("sample", -2 * x * F.sin(omega * F.col("idx"))), taps, chunk)
    return i.select("signal_id", "idx", F.col("sample").alias("i")).join(q.select("signal_id", "idx", F.col("sample").alias("q")), ["signal_id", "idx"])


def envelope(i: Column, q: Column, depth: float = 1.0) -> Column:
    """The sample of an amplitude modulation from its parts."""
    return (F.sqrt(i * i + q * q) - 1.0) / F.lit(depth)


def phase(i: Column, q: Column, gain: float = 1.0) -> Column:
    """The sample of a phase modulation, within half a turn, from its parts."""
    return F.atan2(q, i) / F.lit(gain)


def frequency(parts: DataFrame, gain: float = 1.0, chunk: int = R.CHUNK) -> DataFrame:
    """The samples of a frequency modulation from rows (signal_id, idx, i, q): steps of
    the phase, brought within half a turn; the first is the phase itself."""
    angle = parts.select("signal_id", "idx", F.atan2("q", "i").alias("sample"))
    step = R.fir(angle, [1.0, -1.0], chunk)
    turned = F.pmod(F.col("sample") + math.pi, F.lit(2 * math.pi)) - math.pi
    return step.select("signal_id", "idx", (turned / gain).alias("sample"))


#: User modulations by name: functions of (sample, idx, **options) to a Column.
MODULATIONS: dict[str, Callable[..., Column]] = {"am": am, "pm": pm, "fm": fm}


#: Their inverses: functions of (i, q, **options) to a Column.
DEMODULATIONS: dict[str, Callable[..., Column]] = {"am": envelope, "pm": phase}


def register_modulation(name: str, function: Callable[..., Column], inverse: Callable[..., Column] | None = None) -> None:
    MODULATIONS[name] = function
    if inverse is not None:
        DEMODULATIONS[name] = inverse


def cycle(spark: SparkSession, n: int, period: list[float]) -> DataFrame:
    """A periodic generated signal (idx, sample)."""
    return spark.range(n).select(F.col("id").alias("idx"), F.element_at(F.array(*[F.lit(float(x)) for x in period]), (F.col("id") % len(period) + 1).cast("int")).alias("sample"))


def generate(spark: SparkSession, n: int, f: Callable[[Column], Column]) -> DataFrame:
    """A procedural signal: f of the index."""
    return spark.range(n).select(F.col("id").alias("idx"), f(F.col("id")).alias("sample"))


def hann(n: int) -> list[float]:
    return [0.5 - 0.5 * math.cos(2 * math.pi * k / (n - 1)) for k in range(n)] if n > 1 else [1.0] * n


def hamming(n: int) -> list[float]:
    return [0.54 - 0.46 * math.cos(2 * math.pi * k / (n - 1)) for k in range(n)] if n > 1 else [1.0] * n


def gain(rows: DataFrame, factor: float) -> DataFrame:
    return rows.withColumn("sample", F.col("sample") * factor)


def moving(rows: DataFrame, n: int, chunk: int = R.CHUNK) -> DataFrame:
    """mean and rms of the last n samples (fewer at the start)."""
    by = Window.partitionBy("signal_id", "chunk").orderBy("idx").rowsBetween(-(n - 1), 0)
    x = F.col("sample").cast("double")
    return R.haloed(rows, n - 1, chunk=chunk).select("signal_id", "idx", F.avg(x).over(by).alias("mean"), F.sqrt(F.avg(x * x).over(by)).alias("rms"), "own").where("own").drop("own")


def chunks(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("chunk", F.floor(F.col("idx") / n))


@dataclass
class Pipeline:
    """A lazy chain of signal steps that tracks the sample rate."""

    rate: Fraction
    steps: list[tuple[str, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)

    def then(self, name: str, step: Callable[[DataFrame], DataFrame], rate_factor: Fraction | int = 1) -> Pipeline:
        return Pipeline(self.rate * Fraction(rate_factor), [*self.steps, (name, step)])

    def decimate(self, k: int) -> Pipeline:
        return self.then(f"decimate {k}", lambda x: R.decimate(x, k), Fraction(1, k))

    def upsample(self, k: int) -> Pipeline:
        return self.then(f"upsample {k}", lambda x: R.upsample(x, k), k)

    def fir(self, taps: list[float]) -> Pipeline:
        return self.then("fir", lambda x: R.fir(x, taps))

    def run(self, rows: DataFrame) -> DataFrame:
        for _, step in self.steps:
            rows = step(rows)
        return rows


def mixed(a: tuple[Pipeline, DataFrame], b: tuple[Pipeline, DataFrame]) -> DataFrame:
    """Sum of two pipelines' signals; unequal rates fail."""
    if a[0].rate != b[0].rate:
        raise ValueError(f"rates differ: {a[0].rate} and {b[0].rate}")
    return R.pointwise(a[0].run(a[1]), b[0].run(b[1]), lambda x, y: x + y)
