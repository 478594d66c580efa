"""Streams out of order, and stored signals that are sought, appended to and followed."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.sources import seekable
from sonolith.streaming import chunks, reorder

ROWS = "signal_id long, ts timestamp, tie long, sample double"


def made(spark, n=300, signals=3):
    rng = np.random.default_rng(4)
    rows = [(int(k), float(t), i, float(v)) for i, (k, t, v) in enumerate(zip(rng.integers(0, signals, n), rng.integers(0, 5000, n) * 0.5, rng.standard_normal(n), strict=True))]
    df = spark.createDataFrame(rows, "signal_id long, at double, tie long, sample double")
    return rows, df.select("signal_id", F.timestamp_seconds("at").alias("ts"), "tie", "sample")


def test_late_samples_are_filtered_in_order_of_time(spark):
    rows, df = made(spark)
    stream = reorder.arrivals(df, chunks.shared_path(spark, "arrivals"), 5, "pmod(xxhash64(tie), 400)", 400)
    # Batches do overlap in time.
    spans = [(r["low"], r["high"]) for r in df.withColumn("a", F.unix_seconds("ts") + F.expr("pmod(xxhash64(tie), 400)")).groupBy(F.floor(F.col("a") / 500).alias("b")).agg(F.min("ts").alias("low"), F.max("ts").alias("high")).orderBy("b").collect()]
    assert any(x[1] > y[0] for x, y in zip(spans, spans[1:], strict=False))
    got = chunks.run_to_files(reorder.fir_late(stream, [0.5, -1.0, 0.25], "400 seconds")).collect()
    assert len(got) == len(rows)
    for k in range(3):
        x = np.array([v for s, _, _, v in sorted(rows, key=lambda r: (r[1], r[2])) if s == k])
        mine = {r["idx"]: r["sample"] for r in got if r["signal_id"] == k}
        assert np.allclose([mine[i] for i in range(len(x))], np.convolve(x, [0.5, -1.0, 0.25])[: len(x)])


def test_samples_beyond_the_slack_are_dropped(spark):
    path = chunks.shared_path(spark, "arrivals")
    for rows in ([(1, 1000.0, 0, 1.0)], [(1, 2000.0, 1, 2.0)], [(1, 500.0, 2, 99.0), (1, 1950.0, 3, 3.0)], [(1, 9000.0, 4, None)]):
        df = spark.createDataFrame(rows, "signal_id long, at double, tie long, sample double").select("signal_id", F.timestamp_seconds("at").alias("ts"), "tie", "sample")
        df.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(path)
    got = sorted((r["idx"], r["sample"]) for r in chunks.run_to_files(reorder.fir_late(stream, [1.0], "100 seconds")).collect())
    assert got == [(0, 1.0), (1, 3.0), (2, 2.0)]


@pytest.fixture(scope="module")
def store(spark):
    held = seekable.Store(spark, chunks.shared_path(spark, "signals"))
    rows = spark.range(4000).select((F.col("id") % 4).alias("signal_id"), F.floor(F.col("id") / 4).alias("idx"), (F.col("id") * 0.5).alias("sample"))
    held.append(rows.where("idx < 700"), 0, chunk=32, group_bytes=1024)
    held.append(rows.where("idx >= 700"), 1, chunk=32, group_bytes=1024)
    return held


def plain(df):
    return sorted((r["signal_id"], r["idx"], r["sample"]) for r in df.collect())


def test_reads_and_seeks(store):
    every = [(k, i, (4 * i + k) * 0.5) for k in range(4) for i in range(1000)]
    assert plain(store.read()) == every
    assert plain(store.seek(690, 20)) == [r for r in every if 690 <= r[1] < 710]
    assert plain(store.seek(995, signal=2)) == [r for r in every if r[0] == 2 and r[1] >= 995]
    assert plain(store.seek(5000)) == []
    assert plain(store.read().where("sample > 100 AND idx = 77")) == [r for r in every if r[1] == 77 and r[2] > 100]


def test_a_seek_plans_its_chunks_only(store):
    reader = seekable.Reader(store.path)
    list(reader.pushFilters([seekable.EqualTo(("signal_id",), 2), seekable.GreaterThanOrEqual(("idx",), 320), seekable.LessThan(("idx",), 352)]))
    pieces = reader.partitions()
    assert sum(n for p in pieces for _, n in p.rows) == 32
    read = sum(b.num_rows for p in pieces for b in reader.read(p))
    assert read == 32
    assert sum(b.num_rows for p in seekable.Reader(store.path).partitions() for b in reader.read(p)) == 4000


def test_a_stream_takes_complete_versions_only(spark, store):
    assert plain(chunks.run_to_files(store.follow())) == plain(store.read())
    reader = seekable.StreamReader(store.path)
    assert reader.latestOffset() == {"versions": 2}
    # An append that has no index yet is not read.
    spark.range(1).select(F.lit(9).alias("signal_id"), F.col("id").alias("idx"), F.lit(0.0).alias("sample")).write.parquet(f"{store.path}/version=2/data")
    assert reader.latestOffset() == {"versions": 2} and store.read().count() == 4000
    assert sum(b.num_rows for p in reader.partitions({"versions": 1}, {"versions": 2}) for b in reader.read(p)) == 1200


def test_empty_stores(spark):
    path = f"{chunks.shared_path(spark, 'signals')}-{uuid.uuid4().hex}"
    held = seekable.Store(spark, path)
    held.append(spark.createDataFrame([], seekable.SCHEMA), 0)
    assert held.read().count() == 0 and held.seek(3, 5).count() == 0
