"""Spectra and convolutions of signals that no task can hold, and short-time spectra.

A long transform of n = n1 * n2 points is split into n2 columns of n1 points and, after
a twiddle, n1 rows of n2: two shuffles, and tasks hold a column or row of about sqrt(n)
samples. Two signals are convolved by blocks: each block is transformed once, blocks meet
the other signal's by a join, products that fall on one place are added as spectra, and
the inverse transforms overlap by a block. Short-time spectra are frames that overlap,
weighted by a window; the inverse adds them weighted again and divides by the windows'
sum, which gives the signal back wherever it isn't zero.

Defined results: a signal starts at index 0; null samples and indices without a row count
as 0, and length is the last index plus one; an index occurs once in a signal, and
signal_id is not null; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples of a block.
BLOCK = 1 << 13


def _kind(rows: DataFrame) -> str:
    return rows.schema["signal_id"].dataType.simpleString()


def _split(n: Column) -> tuple[Column, Column]:
    """n1 and n2 of about equal size whose product is n or little more."""
    n1 = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double")))).cast("long")
    return n1, F.ceil(n / n1).cast("long")


def lengths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("signal_id").agg((F.max("idx") + 1).alias("length"))


def _lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each line of a transform: its samples with their places (at, re, im)."""
    return rows.groupBy(*keys).agg(*[F.collect_list(c).alias(c) for c in ("at", "re", "im")])


def _filled(part: pd.DataFrame, size: int) -> np.ndarray:
    x = np.zeros((len(part), size), complex)
    for row, at, re, im in zip(x, part["at"], part["re"], part["im"], strict=True):
        at = np.asarray(at, np.int64)
        row[at] = np.asarray(re, float) + 1j * np.asarray(im, float)
    return x


def _alike(batch: pd.DataFrame, by: list[str], most: int = 1 << 21) -> Iterator[pd.DataFrame]:
    """Rows of equal sizes, at most so many values at once."""
    for sizes, part in batch.groupby(by, sort=False):
        step = max(1, most // max(1, int(sizes[0])))
        for k in range(0, len(part), step):
            yield part.iloc[k : k + step]


def _columns(sign: int):
    """Transforms of columns (n2 fixed), turned by the twiddle: rows by k1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _alike(batch, ["n1", "n2"]):
                n1, n2 = int(part["n1"].iloc[0]), int(part["n2"].iloc[0])
                x = _filled(part, n1)
                got = np.fft.fft(x, axis=1) if sign < 0 else np.fft.ifft(x, axis=1) * n1
                column, k1 = part["line"].to_numpy(np.int64), np.arange(n1)
                # The product of both is taken modulo n, so that the angle keeps its digits.
                got *= np.exp(sign * 2j * np.pi * (np.outer(column, k1) % (n1 * n2)) / (n1 * n2))
                yield pd.DataFrame({"signal_id": part["signal_id"].repeat(n1).to_numpy(), "n1": n1, "n2": n2, "line": np.tile(k1, len(part)), "at": column.repeat(n1), "re": got.real.ravel(), "im": got.imag.ravel()})

    return run


def _rows(sign: int):
    """Transforms of rows (k1 fixed): the points k1 + n1 * k2."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _alike(batch, ["n2", "n1"]):
                n1, n2 = int(part["n1"].iloc[0]), int(part["n2"].iloc[0])
                x = _filled(part, n2)
                got = np.fft.fft(x, axis=1) if sign < 0 else np.fft.ifft(x, axis=1) * n2
                k = part["line"].to_numpy(np.int64)[:, None] + n1 * np.arange(n2)[None, :]
                yield pd.DataFrame({"signal_id": part["signal_id"].repeat(n2).to_numpy(), "n": n1 * n2, "k": k.ravel(), "re": got.real.ravel(), "im": got.imag.ravel()})

    return run


def _transform(points: DataFrame, sign: int) -> DataFrame:
    """(signal_id, idx, re, im, n1, n2) to (signal_id, n, k, re, im); sign -1 is forward, 1 the inverse without its 1 / n."""
    kind = _kind(points)
    columns = points.select("signal_id", "n1", "n2", (F.col("idx") % F.col("n2")).alias("line"), F.floor(F.col("idx") / F.col("n2")).cast("long").alias("at"), "re", "im")
    turned = _lines(columns, ["signal_id", "n1", "n2", "line"]).mapInPandas(_columns(sign), f"signal_id {kind}, n1 long, n2 long, line long, at long, re double, im double")
    return _lines(turned, ["signal_id", "n1", "n2", "line"]).mapInPandas(_rows(sign), f"signal_id {kind}, n long, k long, re double, im double")


def fft_long(rows: DataFrame) -> DataFrame:
    """All n bins of each signal: signal_id, n, k, re, im. n is the signal's length, or up to
    its square root more where the split asks for it; the samples beyond the end are 0."""
    n1, n2 = _split(F.col("length"))
    sized = lengths(rows).select("signal_id", n1.alias("n1"), n2.alias("n2"))
    points = rows.join(sized, "signal_id").select("signal_id", "idx", F.coalesce(F.col("sample").cast("double"), F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"), "n1", "n2")
    return _transform(points, -1)


def inverse_long(spectrum: DataFrame) -> DataFrame:
    """Samples (signal_id, idx, re, im) of full spectra (signal_id, n, k, re, im)."""
    n1, n2 = F.ceil(F.sqrt(F.col("n").cast("double"))).cast("long"), F.lit(0)
    # Any split will do whose product is n: the forward transform's own is n1 = its least divisor from the root on.
    n1 = F.array_min(F.filter(F.sequence(F.lit(1).cast("long"), n1 + 1), lambda d: (F.col("n") % d == 0) & (d * (d + 1) >= F.col("n"))))
    sized = spectrum.select("signal_id", "n").distinct().withColumn("n1", F.coalesce(n1, F.col("n"))).withColumn("n2", F.floor(F.col("n") / F.col("n1")).cast("long")).drop("n")
    points = spectrum.join(sized, "signal_id").select("signal_id", F.col("k").alias("idx"), "re", "im", "n1", "n2")
    return _transform(points, 1).select("signal_id", F.col("k").alias("idx"), (F.col("re") / F.col("n")).alias("re"), (F.col("im") / F.col("n")).alias("im"))


def _spectra(rows: DataFrame, block: int) -> DataFrame:
    """signal_id, block, spectrum (re and im interleaved) of each block, filled with as many zeros."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), max(1, (1 << 20) // block)):
                part = batch.iloc[k : k + max(1, (1 << 20) // block)]
                x = np.zeros((len(part), 2 * block))
                for row, at, samples in zip(x, part["at"], part["samples"], strict=True):
                    row[np.asarray(at, np.int64)] = samples
                got = np.fft.rfft(x, axis=1)
                yield part[["signal_id", "block"]].assign(spectrum=[r.tobytes() for r in got])

    held = rows.select("signal_id", F.floor(F.col("idx") / block).cast("long").alias("block"), (F.col("idx") % block).alias("at"), F.coalesce(F.col("sample").cast("double"), F.lit(0.0)).alias("sample"))
    held = held.groupBy("signal_id", "block").agg(F.collect_list("at").alias("at"), F.collect_list("sample").alias("samples"))
    return held.mapInPandas(run, f"signal_id {_kind(rows)}, block long, spectrum binary")


def convolve_pair(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """Full linear convolution of the signals of one id in a and b: n_a + n_b - 1 samples
    (signal_id, idx, sample). An id in only one of them has no result."""
    kind = _kind(a)
    size = lengths(a).select("signal_id", F.col("length").alias("n_a")).join(lengths(b).select("signal_id", F.col("length").alias("n_b")), "signal_id")
    # Each block of the first meets each of the second under the second's own key, not its signal's alone.
    blocks_b = F.floor((F.col("n_b") - 1) / block).cast("long")
    left = _spectra(a, block).join(size.select("signal_id", blocks_b.alias("last")), "signal_id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    right = _spectra(b, block).select("signal_id", F.col("block").alias("other"), F.col("spectrum").alias("with"))
    pairs = left.join(right, ["signal_id", "other"]).select("signal_id", (F.col("block") + F.col("other")).alias("place"), "spectrum", "with")
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of the products that fall on one place, a place at a time, as segments of two blocks."""
        at, total = None, None
        for batch in batches:
            done = []
            for signal, place, x, y in zip(batch["signal_id"], batch["place"], batch["spectrum"], batch["with"], strict=True):
                product = np.frombuffer(x, complex) * np.frombuffer(y, complex)
                if at == (signal, place):
                    total += product
                    continue
                if at is not None:
                    done.append((*at, np.fft.irfft(total, 2 * block)))
                at, total = (signal, place), product
            if done:
                yield pd.DataFrame(done, columns=["signal_id", "place", "samples"])
        if at is not None:
            yield pd.DataFrame([(*at, np.fft.irfft(total, 2 * block))], columns=["signal_id", "place", "samples"])

    segments = pairs.repartition(parts, "signal_id", "place").sortWithinPartitions("signal_id", "place").mapInPandas(added, f"signal_id {kind}, place long, samples array<double>")
    each = segments.select("signal_id", "place", F.posexplode("samples").alias("at", "sample")).select("signal_id", (F.col("place") * block + F.col("at")).alias("idx"), "sample")
    whole = each.groupBy("signal_id", "idx").agg(F.sum("sample").alias("sample")).join(size, "signal_id")
    return whole.where(F.col("idx") < F.col("n_a") + F.col("n_b") - 1).select("signal_id", "idx", "sample")


def root_hann(size: int) -> np.ndarray:
    """A periodic window whose squares add up to one at a hop of half its size."""
    return np.sin(np.pi * np.arange(size) / size)


def stft(rows: DataFrame, size: int, hop: int, window: np.ndarray | None = None) -> DataFrame:
    """signal_id, frame, k (0 to size / 2), re, im: frame f has the samples from (f + 1) * hop - size
    on, so that every sample lies in as many frames as any other."""
    weights, kind = root_hann(size) if window is None else np.asarray(window, float), _kind(rows)
    if len(weights) != size or not 0 < hop <= size:
        raise ValueError(f"a window of {len(weights)} for frames of {size} with a hop of {hop}")
    first = F.floor(F.col("idx") / hop).cast("long")
    last = F.floor((F.col("idx") + size - hop) / hop).cast("long")
    each = rows.select("signal_id", "idx", F.coalesce(F.col("sample").cast("double"), F.lit(0.0)).alias("sample"), F.explode(F.sequence(first, last)).alias("frame"))
    each = each.select("signal_id", "frame", (F.col("idx") - (F.col("frame") + 1) * hop + size).alias("at"), "sample")
    held = each.groupBy("signal_id", "frame").agg(F.collect_list("at").alias("at"), F.collect_list("sample").alias("samples"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.zeros((len(batch), size))
            for row, at, samples in zip(x, batch["at"], batch["samples"], strict=True):
                row[np.asarray(at, np.int64)] = samples
            got = np.fft.rfft(x * weights, axis=1)
            n = got.shape[1]
            yield pd.DataFrame({"signal_id": batch["signal_id"].repeat(n).to_numpy(), "frame": batch["frame"].repeat(n).to_numpy(), "k": np.tile(np.arange(n), len(batch)), "re": got.real.ravel(), "im": got.imag.ravel()})

    return held.mapInPandas(run, f"signal_id {kind}, frame long, k long, re double, im double")


def inverse_stft(spectra: DataFrame, size: int, hop: int, window: np.ndarray | None = None) -> DataFrame:
    """signal_id, idx, sample from (signal_id, frame, k, re, im), by overlap-add: the last frames
    reach up to size - hop samples beyond the signal's end, where it is 0."""
    weights, kind = root_hann(size) if window is None else np.asarray(window, float), _kind(spectra)
    held = spectra.select("signal_id", "frame", F.col("k").alias("at"), "re", "im")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = np.fft.irfft(_filled(batch, size // 2 + 1), size, axis=1) * weights
            idx = (batch["frame"].to_numpy(np.int64)[:, None] + 1) * hop - size + np.arange(size)[None, :]
            yield pd.DataFrame({"signal_id": batch["signal_id"].repeat(size).to_numpy(), "idx": idx.ravel(), "sample": got.ravel(), "weight": np.tile(weights * weights, len(batch))})

    each = _lines(held, ["signal_id", "frame"]).mapInPandas(run, f"signal_id {kind}, idx long, sample double, weight double")
    total = each.where("idx >= 0").groupBy("signal_id", "idx").agg(F.sum("sample").alias("sample"), F.sum("weight").alias("weight"))
    return total.where("weight > 1e-12").select("signal_id", "idx", (F.col("sample") / F.col("weight")).alias("sample"))


def resample_sinc(rows: DataFrame, up: int, down: int, half: int = 16, cut: float = 0.95) -> DataFrame:
    """ceil(n * up / down) samples at the rational rate up / down through an anti-aliasing
    filter: a windowed sinc of `half` lobes to each side, cut below the lower Nyquist rate.

    Result m stands at m * down / up of the old samples. Its phase, m * down mod up, names one
    of `up` sets of taps; each old sample meets the results within its reach by their phase."""
    if up < 1 or down < 1:
        raise ValueError(f"a rate of {up} / {down}")
    common = math.gcd(up, down)
    up, down = up // common, down // common
    scale = min(1.0, up / down) * cut
    reach = math.ceil(half / min(1.0, up / down))

    def tap(at: float) -> float:
        if abs(at) >= reach:
            return 0.0
        sinc = 1.0 if at == 0 else math.sin(math.pi * scale * at) / (math.pi * scale * at)
        return scale * sinc * (0.42 + 0.5 * math.cos(math.pi * at / reach) + 0.08 * math.cos(2 * math.pi * at / reach))

    # The bank: offsets from floor(m * down / up) and, for each phase, weights that add up to one.
    bank = []
    for phase in range(up):
        taps = [tap(j - phase / up) for j in range(1 - reach, reach + 1)]
        bank += [(phase, j, w / sum(taps)) for j, w in zip(range(1 - reach, reach + 1), taps, strict=True)]
    spark = rows.sparkSession
    taps = spark.createDataFrame(bank, "phase long, offset long, weight double")
    # Each old sample gives the results m with floor(m * down / up) = idx - offset.
    low = F.col("idx") - F.col("offset")
    first, beyond = F.ceil(low * up / down).cast("long"), F.ceil((low + 1) * up / down).cast("long") - 1
    spread = rows.select("signal_id", "idx", F.coalesce(F.col("sample").cast("double"), F.lit(0.0)).alias("sample"), F.explode(F.sequence(F.lit(1 - reach).cast("long"), F.lit(reach).cast("long"))).alias("offset"))
    spread = spread.where(low >= 0).withColumn("m", F.explode(F.when(beyond >= first, F.sequence(first, beyond))))
    spread = spread.withColumn("phase", F.col("m") * down % up)
    met = spread.join(F.broadcast(taps), ["phase", "offset"])  # up * 2 * reach rows
    size = lengths(rows).select("signal_id", F.ceil(F.col("length") * up / down).cast("long").alias("n"))
    got = met.groupBy("signal_id", F.col("m").alias("idx")).agg(F.sum(F.col("sample") * F.col("weight")).alias("sample"))
    return got.join(size, "signal_id").where(F.col("idx") < F.col("n")).select("signal_id", "idx", "sample")
