"""Signals as streams: tumbling chunks and a stateful causal filter.

A micro-batch is the smallest unit, so latencies are those of Structured
Streaming, not of audio hardware.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str = "1 day", time: str = "ts", sample: str = "value", late: str = "1 hour") -> DataFrame:
    """Count, sum, min and max of each chunk of time; the same for tables and streams.
    Streams drop samples later than the watermark."""
    held = events.withColumn("at", F.col(time).cast("timestamp"))
    if events.isStreaming:
        held = held.withWatermark("at", late)
    grouped = held.groupBy(F.window("at", width)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(sample).cast("decimal(12,2)")).cast("double").alias("total"), F.min(sample).alias("low"), F.max(sample).alias("high"))
    return grouped.select(F.col("window.start").cast("timestamp_ntz").alias("chunk_start"), "n", "total", "low", "high")


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All of what is there now, through the memory sink (for small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, or in a temporary folder where that is unset
    and one machine does all the work."""
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not home:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        home = tempfile.mkdtemp(prefix="sonolith-", dir="/tmp")
    return f"{home}/{name}-{uuid.uuid4().hex}"


def run_to_files(stream: DataFrame) -> DataFrame:
    """All of what is there now, through the file sink: written by the executors and
    read again, so results of any size do not pass through the driver."""
    spark = stream.sparkSession
    path = shared_path(spark, "stream")
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-progress").outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def fir_stream(stream: DataFrame, taps: list[float]) -> DataFrame:
    """A causal filter over (signal_id, idx, sample) that arrives in order; the
    state of a signal is its last len(taps) - 1 samples."""
    weights = np.array(taps, float)
    keep = len(taps) - 1

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail = np.array(state.get[0], float) if state.exists else np.zeros(keep)
        whole = pd.concat(list(parts)).sort_values("idx")
        x = np.concatenate([tail, whole["sample"].to_numpy(float)])
        total = np.zeros(len(whole))
        for k, c in enumerate(weights):
            total = total + c * x[keep - k : len(x) - k]
        state.update((x[len(x) - keep :].tolist(),))
        yield pd.DataFrame({"signal_id": key[0], "idx": whole["idx"].to_numpy(), "sample": total})

    return stream.groupBy("signal_id").applyInPandasWithState(run, "signal_id long, idx long, sample double", "tail array<double>", "append", GroupStateTimeout.NoTimeout)
