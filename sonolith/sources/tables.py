"""Reading tables as signals and writing signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.operators import rows as R


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_signals(spark: SparkSession, folder: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Row form: a signal per user, in order of time, then event."""
    return R.from_series(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "value", keep)


def embedding_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Array form, in double."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("signal_id"), F.col("embedding").cast("array<double>").alias("samples"))


def unbounded(spark: SparkSession, rate: int, f) -> DataFrame:
    """A procedural stream of samples: f of the index."""
    return spark.readStream.format("rate").option("rowsPerSecond", rate).load().select(F.col("timestamp").alias("ts"), F.col("value").alias("idx"), f(F.col("value")).alias("sample"))


def write_signals(rows: DataFrame, path: str, buckets: int = 0) -> None:
    """Row-form signals as Parquet, dealt by signal where buckets are asked for."""
    (rows.repartition(buckets, "signal_id").sortWithinPartitions("signal_id", "idx") if buckets else rows).write.mode("errorifexists").parquet(path)
