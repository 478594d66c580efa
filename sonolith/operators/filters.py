"""Recursive (IIR) filters over signals of any length, by a scan of affine state maps.

A cascade of biquads is one linear system: s' = A s + B x, y = C s + D x. Each chunk of
a signal is filtered from a zero state, and leaves an end state v. The state in which a
chunk of n samples starts carries over as A^n s + v, so the starts of all chunks follow
from their end states alone: these are composed in groups of chunks first, then over
groups, then within groups. A start adds C A^t s to the sample at place t. So no task
holds more than a chunk, a group's end states, or those of a signal's groups.

Defined results: a signal starts at index 0 from rest; null samples and indices without
a row count as 0, and null samples have a result, missing rows none; NaN and infinities
spread to all later samples, as the recursion does; an index occurs once in a signal, and
signal_id is not null; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.streaming.chunks import shared_path

#: Samples of a chunk, chunks of a group.
CHUNK, GROUP = 1 << 14, 1 << 10

#: b0, b1, b2, a1, a2 of y[n] = b0 x[n] + b1 x[n-1] + b2 x[n-2] - a1 y[n-1] - a2 y[n-2].
Biquad = tuple[float, float, float, float, float]


def _biquad(b: tuple[float, float, float], a: tuple[float, float, float]) -> Biquad:
    return (b[0] / a[0], b[1] / a[0], b[2] / a[0], a[1] / a[0], a[2] / a[0])


def _angle(frequency: float) -> tuple[float, float]:
    if not 0 < frequency < 0.5:
        raise ValueError(f"a frequency is a share of the rate between 0 and 0.5: {frequency}")
    return math.cos(2 * math.pi * frequency), math.sin(2 * math.pi * frequency)


def low_pass(frequency: float, q: float = math.sqrt(0.5)) -> Biquad:
    cos, sin = _angle(frequency)
    alpha = sin / (2 * q)
    return _biquad(((1 - cos) / 2, 1 - cos, (1 - cos) / 2), (1 + alpha, -2 * cos, 1 - alpha))


def high_pass(frequency: float, q: float = math.sqrt(0.5)) -> Biquad:
    cos, sin = _angle(frequency)
    alpha = sin / (2 * q)
    return _biquad(((1 + cos) / 2, -(1 + cos), (1 + cos) / 2), (1 + alpha, -2 * cos, 1 - alpha))


def band_pass(frequency: float, q: float = 1.0) -> Biquad:
    """A gain of one at the frequency."""
    cos, sin = _angle(frequency)
    alpha = sin / (2 * q)
    return _biquad((alpha, 0.0, -alpha), (1 + alpha, -2 * cos, 1 - alpha))


def notch(frequency: float, q: float = 1.0) -> Biquad:
    cos, sin = _angle(frequency)
    alpha = sin / (2 * q)
    return _biquad((1.0, -2 * cos, 1.0), (1 + alpha, -2 * cos, 1 - alpha))


def all_pass(frequency: float, q: float = 1.0) -> Biquad:
    cos, sin = _angle(frequency)
    alpha = sin / (2 * q)
    return _biquad((1 - alpha, -2 * cos, 1 + alpha), (1 + alpha, -2 * cos, 1 - alpha))


def peak(frequency: float, decibels: float, q: float = 1.0) -> Biquad:
    cos, sin = _angle(frequency)
    alpha, gain = sin / (2 * q), 10 ** (decibels / 40)
    return _biquad((1 + alpha * gain, -2 * cos, 1 - alpha * gain), (1 + alpha / gain, -2 * cos, 1 - alpha / gain))


def one_pole(share: float) -> Biquad:
    """Exponential smoothing: y[n] = share x[n] + (1 - share) y[n-1]."""
    return (share, 0.0, 0.0, share - 1.0, 0.0)


def butterworth(order: int, frequency: float, high: bool = False) -> list[Biquad]:
    """A cascade whose response is as flat as an order allows."""
    cos, sin = _angle(frequency)
    shape = high_pass if high else low_pass
    out = [shape(frequency, 1 / (2 * math.sin(math.pi * (2 * k + 1) / (2 * order)))) for k in range(order // 2)]
    if order % 2:
        t = sin / (1 + cos)
        out.append(_biquad((1.0, -1.0, 0.0) if high else (t, t, 0.0), (1 + t, t - 1, 0.0)))
    return out


def response(cascade: list[Biquad], frequency: float) -> complex:
    """Gain and phase of the cascade at a frequency."""
    z = complex(math.cos(2 * math.pi * frequency), -math.sin(2 * math.pi * frequency))
    out = 1 + 0j
    for b0, b1, b2, a1, a2 in cascade:
        out *= (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
    return out


class System:
    """The cascade as a linear system of two states a biquad (transposed direct form)."""

    def __init__(self, cascade: list[Biquad]):
        if not cascade:
            raise ValueError("a cascade has one biquad at least")
        self.cascade, self.states = cascade, 2 * len(cascade)
        unit = np.eye(self.states + 1)
        # Columns: what one step makes of each unit state, and of a unit sample at rest.
        y, s = self.step(unit[:, :-1], unit[:, -1])
        self.a, self.c = s[:-1].T, y[:-1]

    def step(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Samples and states of many signals, from their states (rows) and next samples."""
        out = np.empty_like(state)
        for k, (b0, b1, b2, a1, a2) in enumerate(self.cascade):
            y = b0 * x + state[:, 2 * k]
            out[:, 2 * k] = b1 * x - a1 * y + state[:, 2 * k + 1]
            out[:, 2 * k + 1] = b2 * x - a2 * y
            x = y
        return x, out

    def from_rest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Results and end states of many chunks (rows of equal length) that start at rest."""
        state, y = np.zeros((len(x), self.states)), np.empty_like(x)
        for t in range(x.shape[1]):
            y[:, t], state = self.step(state, x[:, t])
        return y, state

    def echoes(self, n: int) -> np.ndarray:
        """What each unit state adds to the n samples after it."""
        out, row = np.empty((n, self.states)), self.c
        for t in range(n):
            out[t] = row
            row = row @ self.a
        return out

    def power(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.a, n)


    # What `scanned` asks of a system:

    @property
    def rest(self) -> np.ndarray:
        return np.zeros(self.states)

    def ends(self, x: np.ndarray) -> np.ndarray:
        return self.from_rest(x)[1]

    def finish(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        return self.from_rest(x)[0] + start @ self.echoes(x.shape[1]).T

    def over(self, map_: np.ndarray, n: int) -> np.ndarray:
        """The map followed by n samples of 0."""
        return self.power(n) @ map_

    def then(self, map_: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
        """The map followed by n samples whose own map is `end`."""
        return self.over(map_, n) + end


def scan(system, places: np.ndarray, ends: np.ndarray, span: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The map up to each of the sorted places, of `span` samples each, and that after the
    last. Places left out are samples of 0. start holds at places[0]."""
    out, s = np.empty_like(ends), start
    for k, end in enumerate(ends):
        if k and places[k] - places[k - 1] > 1:
            s = system.over(s, (int(places[k] - places[k - 1]) - 1) * span)
        out[k] = s
        s = system.then(s, end, span)
    return out, s


def _matrix(arrays: pd.Series, width: int) -> np.ndarray:
    return np.stack(list(arrays)) if len(arrays) else np.zeros((0, width))


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """rows written once to the shared folder, as they are read more than once: a filter of a filter
    would otherwise compute the first one for each reading of the second."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def walked(rows: DataFrame, by: list[str], then: str, work, schema: str) -> DataFrame:
    """work(part, spans) over the groups of `by`, sorted by `then`: many small groups a call,
    since a call for each costs more than its work. spans: begins and ends of the part's groups."""

    def spans(part: pd.DataFrame) -> list[tuple[int, int]]:
        new = np.zeros(len(part) - 1, bool)
        for name in by:
            a, b = part[name].to_numpy()[:-1], part[name].to_numpy()[1:]
            new |= (a != b) & ((a == a) | (b == b))
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(part)]
        return list(zip(cuts[:-1], cuts[1:], strict=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            # A group goes on where the last row so far and the batch's first are alike.
            whole = pd.concat([*(r.iloc[-1:] for r in rest[-1:]), batch], ignore_index=True)
            found, own = spans(whole), len(whole) - len(batch)
            if own and found[0][1] > own or not rest:
                first, found = (found[0][1] - own, found[1:])
            else:
                first, found = 0, found[1:] if own else found
            rest.append(batch.iloc[:first])
            if found:
                done = pd.concat(rest, ignore_index=True)
                yield work(done, [(0, len(done))])
                last = found[-1][0] - own
                if last > first:
                    middle = batch.iloc[first:last].reset_index(drop=True)
                    yield work(middle, spans(middle))
                rest = [batch.iloc[last:]]
            rest = [r for r in rest if len(r)]
        if rest:
            done = pd.concat(rest, ignore_index=True)
            yield work(done, [(0, len(done))])

    return rows.repartition(*by).sortWithinPartitions(*by, then).mapInPandas(run, schema)


def scanned(rows: DataFrame, system, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """The signals through a system whose samples compose as maps of its state: signal_id,
    idx, sample. system: `rest` is the map of no samples, `ends` those of chunks (rows of
    equal length), `then` and `over` compose, and `finish` gives results from the maps up
    to the chunks. Chunks compose within groups, groups over the signal."""
    width, kind = len(system.rest), rows.schema["signal_id"].dataType.simpleString()
    held = rows.select("signal_id", F.floor(F.col("idx") / chunk).cast("long").alias("chunk"), (F.col("idx") % chunk).cast("int").alias("at"), F.col("sample").cast("double").alias("sample"))
    held = held.groupBy("signal_id", "chunk").agg(F.collect_list("at").alias("at"), F.collect_list(F.coalesce("sample", F.lit(0.0))).alias("samples"))
    held = _kept(held, "chunks")

    def matrices(batches: Iterator[pd.DataFrame], whole: bool) -> Iterator[tuple]:
        # As many chunks at once as a bounded matrix holds.
        most = max(1, (1 << 21) // chunk)
        for batch in batches:
            for k in range(0, len(batch), most):
                part = batch.iloc[k : k + most]
                at = [np.asarray(x, np.int64) for x in part["at"]]
                x = np.zeros((len(part), max(int(a.max()) + 1 for a in at) if whole else chunk))
                for row, a, samples in zip(x, at, part["samples"], strict=True):
                    row[a] = samples
                yield part, at, x

    def ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, _, x in matrices(batches, False):
            yield part[["signal_id", "chunk"]].assign(end=list(system.ends(x)))

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, at, x in matrices(batches, True):
            y = system.finish(x, _matrix(part["start"], width))
            idx = np.concatenate([c * chunk + a for c, a in zip(part["chunk"], at, strict=True)])
            yield pd.DataFrame({"signal_id": part["signal_id"].repeat([len(a) for a in at]).to_numpy(), "idx": idx, "sample": np.concatenate([row[a] for row, a in zip(y, at, strict=True)])})

    def composed(part: pd.DataFrame, spans: list[tuple[int, int]]) -> pd.DataFrame:
        """Groups of chunks as one map each."""
        chunks, ends, out = part["chunk"].to_numpy(), _matrix(part["end"], width), []
        for lo, hi in spans:
            number = int(chunks[lo]) // group
            first = system.over(system.rest, (int(chunks[lo]) - number * group) * chunk)
            _, s = scan(system, chunks[lo:hi], ends[lo:hi], chunk, first)
            out.append(system.over(s, ((number + 1) * group - 1 - int(chunks[hi - 1])) * chunk))
        return part[["signal_id", "group"]].iloc[[lo for lo, _ in spans]].assign(end=out)

    def group_starts(part: pd.DataFrame, spans: list[tuple[int, int]]) -> pd.DataFrame:
        places, ends, out = part["group"].to_numpy(), _matrix(part["end"], width), []
        for lo, hi in spans:
            first = system.over(system.rest, int(places[lo]) * group * chunk)
            out += list(scan(system, places[lo:hi], ends[lo:hi], chunk * group, first)[0])
        return part[["signal_id", "group"]].assign(start=out)

    def chunk_starts(part: pd.DataFrame, spans: list[tuple[int, int]]) -> pd.DataFrame:
        chunks, ends, starts, out = part["chunk"].to_numpy(), _matrix(part["end"], width), part["start"].to_numpy(object), []
        for lo, hi in spans:
            first = system.over(np.asarray(starts[lo]), int(chunks[lo]) % group * chunk)
            out += list(scan(system, chunks[lo:hi], ends[lo:hi], chunk, first)[0])
        return part[["signal_id", "chunk"]].assign(start=out)

    ends = _kept(held.mapInPandas(ended, f"signal_id {kind}, chunk long, end array<double>"), "ends")
    ends = ends.withColumn("group", F.floor(F.col("chunk") / group).cast("long"))
    groups = walked(ends, ["signal_id", "group"], "chunk", composed, f"signal_id {kind}, group long, end array<double>")
    groups = walked(groups, ["signal_id"], "group", group_starts, f"signal_id {kind}, group long, start array<double>")
    starts = walked(ends.join(groups, ["signal_id", "group"]), ["signal_id", "group"], "chunk", chunk_starts, f"signal_id {kind}, chunk long, start array<double>")
    both = held.join(starts, ["signal_id", "chunk"]).select("signal_id", "chunk", "at", "samples", "start")
    return both.mapInPandas(finished, f"signal_id {kind}, idx long, sample double")


def iir(rows: DataFrame, cascade: list[Biquad], chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """The signals through a cascade of biquads: signal_id, idx, sample."""
    return scanned(rows, System(cascade), chunk, group)
