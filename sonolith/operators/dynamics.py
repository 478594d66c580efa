"""Level dynamics of signals of any length: peak envelope, compressor, expander and gate.

A level u rises at once and falls by its release, y[n] = max(u[n], r y[n-1] + (1 - r) u[n]),
and a one-pole filter smooths the rise by its attack. The first is piecewise linear with one
bend, and so is any composition of such steps: y -> max(m, a y + b), of which a is known
from the number of samples. Chunks so compose by two numbers (`filters.scanned`), and the
second is a recursive filter. Gains are computed in decibels below or above a threshold.

Defined results: as in `filters`: a signal starts at index 0 from rest, null samples are
samples of 0 and have results; a sample of 0 is as loud as FLOOR decibels. A signal should
have every index: where rows are missing, the released level falls as over samples of 0,
but the attack's filter sees a level of 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.operators.filters import CHUNK, GROUP, iir, one_pole, scanned

#: Decibels of silence.
FLOOR = -200.0


class Release:
    """Levels of at least 0 that rise at once and fall by a share of the distance a sample."""

    def __init__(self, share: float):
        if not 0 < share <= 1:
            raise ValueError(f"a share of the distance is above 0 and 1 at most: {share}")
        self.keep = 1 - share

    @property
    def rest(self) -> np.ndarray:
        """m and b of y -> max(m, a y + b), where a is 1."""
        return np.array([-np.inf, 0.0])

    def ends(self, x: np.ndarray) -> np.ndarray:
        m, b = np.full(len(x), -np.inf), np.zeros(len(x))
        for u in x.T:
            m, b = np.maximum(u, self.keep * m + (1 - self.keep) * u), self.keep * b + (1 - self.keep) * u
        return np.stack([m, b], 1)

    def finish(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        y, out = np.maximum(start[:, 0], start[:, 1]), np.empty_like(x)
        for t, u in enumerate(x.T):
            y = np.maximum(u, self.keep * y + (1 - self.keep) * u)
            out[:, t] = y
        return out

    def over(self, map_: np.ndarray, n: int) -> np.ndarray:
        return self.then(map_, np.array([0.0, 0.0]), n) if n else map_

    def then(self, map_: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
        a = self.keep**n
        # Nothing before (m at minus infinity) stays nothing, also where a is 0.
        m = a * map_[0] + end[1] if np.isfinite(map_[0]) else -np.inf
        return np.array([max(end[0], m), a * map_[1] + end[1]])


def envelope(rows: DataFrame, attack: float, release: float, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """The peak envelope of each signal's sizes; attack and release: shares of the distance a sample."""
    sizes = rows.select("signal_id", "idx", F.abs(F.col("sample").cast("double")).alias("sample"))
    return iir(scanned(sizes, Release(release), chunk, group), [one_pole(attack)], chunk, group)


def decibels(x: Column) -> Column:
    return F.greatest(F.lit(FLOOR), F.coalesce(20 * F.log10(F.abs(x.cast("double"))), F.lit(FLOOR)))


def above(level: Column, threshold: float, ratio: float, knee: float) -> Column:
    """Decibels that a compressor takes away: what is above the threshold goes on by 1 / ratio, with a
    quadratic bend of the knee's width around the threshold."""
    over = level - threshold
    slope = 1 - 1 / ratio
    bend = slope * (over + knee / 2) * (over + knee / 2) / (2 * knee) if knee else F.lit(0.0)
    return F.when(2 * over < -knee, 0.0).when(2 * F.abs(over) <= knee, bend).otherwise(slope * over)


def below(level: Column, threshold: float, ratio: float, most: float) -> Column:
    """Decibels that an expander takes away below the threshold, `most` at most; a gate has a large ratio."""
    return F.when(level < threshold, F.least(F.lit(most), (ratio - 1) * (threshold - level))).otherwise(0.0)


def _reduced(rows: DataFrame, less: Column, attack: float, release: float, gain: float, chunk: int, group: int) -> DataFrame:
    """Samples less the decibels `less`, as attack and release let them change."""
    taken = scanned(rows.select("signal_id", "idx", less.alias("sample")), Release(release), chunk, group)
    taken = iir(taken, [one_pole(attack)], chunk, group).withColumnRenamed("sample", "taken")
    return rows.select("signal_id", "idx", "sample").join(taken, ["signal_id", "idx"]).select("signal_id", "idx", (F.col("sample") * F.pow(F.lit(10.0), (gain - F.col("taken")) / 20)).alias("sample"))


def compress(rows: DataFrame, threshold: float, ratio: float, attack: float, release: float, knee: float = 0.0, gain: float = 0.0, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """Samples louder than the threshold (decibels) made quieter, then all by `gain` decibels louder."""
    return _reduced(rows, above(decibels(F.col("sample")), threshold, ratio, knee), attack, release, gain, chunk, group)


def gate(rows: DataFrame, threshold: float, attack: float, release: float, ratio: float = 10.0, most: float = 80.0, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """Samples quieter than the threshold made quieter yet. Gates close by `attack` and open by `release`."""
    return _reduced(rows, below(decibels(F.col("sample")), threshold, ratio, most), attack, release, 0.0, chunk, group)
