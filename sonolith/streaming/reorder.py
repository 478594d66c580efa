"""Streams whose samples arrive late or out of order: a buffer in state, and timers of event time.

Signals are dealt to buckets by a hash, since a state and calls for each signal cost more than
its work. A bucket keeps the samples that are newer than the watermark. When the watermark
passes them they leave in order of time and tie, are numbered, and go through a causal
filter whose last samples are state as well. Samples that are later than the slack, so
behind the watermark on arrival, are dropped by the engine, as its metrics tell.

The buffer of a bucket holds its signals' samples of one slack; state lies in RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups of signals that share a state, so that a call serves many.
BUCKETS = 256


class Ordered(StatefulProcessor):
    """Releases a bucket's samples in order behind the watermark, each signal's filtered by taps."""

    def __init__(self, taps: list[float], kind: str):
        self.taps, self.kind = np.array(taps, float), kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"signal {self.kind}, at long, tie long, sample double")
        self.last = handle.getListState("last", f"signal {self.kind}, n long, tail array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            # A row without a sample only moves the watermark.
            part = part[part["sample"].notna()]
            if len(part):
                self.waiting.appendList(list(zip(part["signal_id"].tolist(), part["at"].tolist(), part["tie"].tolist(), part["sample"].tolist(), strict=True)))
                low = int(part["at"].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = [], []
        for x in self.waiting.get():
            (ready if x[1] <= passed else rest).append(x)
        if rest:
            self.handle.registerTimer(min(x[1] for x in rest) // 1000 + 1)
        if not ready:
            return
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        keep = len(self.taps) - 1
        known = {s: (n, tail) for s, n, tail in self.last.get()} if self.last.exists() else {}
        number: dict = {}
        code = np.array([number.setdefault(x[0], len(number)) for x in ready])
        at, tie, sample = (np.array([x[k] for x in ready]) for k in (1, 2, 3))
        order = np.lexsort((sample, tie, at, code))
        sizes = np.bincount(code)
        begun = [known.get(s, (0, [0.0] * keep)) for s in number]
        # Before each signal's samples stand its last ones so far.
        ends = np.cumsum(sizes + keep)
        place = np.arange(len(ready)) + np.repeat((np.arange(len(sizes)) + 1) * keep, sizes)
        x = np.empty(int(ends[-1]))
        x[place] = sample[order]
        if keep:
            x[(ends - sizes - keep)[:, None] + np.arange(keep)] = np.array([tail for _, tail in begun], float)
        total = np.zeros(len(ready))
        for k, c in enumerate(self.taps):
            total = total + c * x[place - k]
        counts = np.array([n for n, _ in begun], np.int64)
        for s, n, end in zip(number, (counts + sizes).tolist(), ends.tolist(), strict=True):
            known[s] = (n, x[end - keep : end].tolist())
        self.last.put([(s, n, list(tail)) for s, (n, tail) in known.items()])
        signals = np.array(list(number), object)[code[order]]
        idx = np.repeat(counts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ready))
        yield pd.DataFrame({"signal_id": signals, "idx": idx, "sample": total})

    def close(self) -> None:
        pass


def fir_late(stream: DataFrame, taps: list[float], slack: str) -> DataFrame:
    """A causal filter over (signal_id, ts, tie, sample), in order of (ts, tie) whatever the order
    of arrival within `slack`: signal_id, idx, sample. Null samples only move the watermark."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kind = stream.schema["signal_id"].dataType.simpleString()
    held = stream.withWatermark("ts", slack).select(F.pmod(F.xxhash64("signal_id"), F.lit(BUCKETS)).alias("bucket"), "signal_id", "ts", F.unix_micros("ts").alias("at"), "tie", "sample")
    return held.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Ordered(taps, kind), outputStructType=f"signal_id {kind}, idx long, sample double", outputMode="Append", timeMode="EventTime")


def arrivals(rows: DataFrame, path: str, batches: int, delay: str, slack_seconds: int) -> DataFrame:
    """rows (signal_id, ts, tie, sample) as a stream in which each arrives up to the slack after its
    time: written as files in the order of arrival, read one by one, and closed by a row
    beyond the slack. delay: an expression of seconds, at least 0 and under the slack."""
    spark: SparkSession = rows.sparkSession
    late = rows.withColumn("arrival", F.unix_seconds("ts") + F.expr(delay))
    low, high = late.agg(F.min("arrival"), F.max("arrival")).first()
    schema = rows.schema
    for k in range(batches if low is not None else 0):
        place = F.least(F.lit(batches - 1), F.floor((F.col("arrival") - low) * batches / max(1, high - low)))
        late.where(place == k).select(*rows.columns).coalesce(1).write.mode("append").parquet(path)
    if low is not None:
        end = rows.orderBy(F.desc("ts")).limit(1).select("signal_id", F.timestamp_seconds(F.lit(high + 2 * slack_seconds)).alias("ts"), F.lit(0).cast("long").alias("tie"), F.lit(None).cast("double").alias("sample"))
        end.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
