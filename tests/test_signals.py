"""Signals: both forms agree, laws hold, and streams equal batches."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.operators import arrays as A
from sonolith.operators import dsp as D
from sonolith.operators import rows as R
from sonolith.sources import tables
from sonolith.streaming import chunks


@pytest.fixture(scope="module")
def held(spark):
    rng = random.Random(1)
    data = {s: [round(rng.uniform(-5, 5), 2) for _ in range(n)] for s, n in ((1, 40), (2, 33), (3, 1))}
    arrays = spark.createDataFrame(list(data.items()), "signal_id long, samples array<double>").cache()
    return data, arrays, R.from_arrays(arrays, "signal_id", "samples").cache()


def series(rows, name="sample"):
    out = {}
    for r in rows.orderBy("signal_id", "idx").collect():
        out.setdefault(r["signal_id"], []).append(r[name])
    return out


def test_forms_agree(held):
    data, arrays, rows = held
    assert {r.signal_id: r.samples for r in R.to_arrays(rows).collect()} == data
    a = F.col("samples")
    left = {r.signal_id: r for r in arrays.select("signal_id", A.minimum(a).alias("min"), A.maximum(a).alias("max"), A.argmin(a).alias("argmin"), A.argmax(a).alias("argmax"), A.mean(a).alias("mean"), A.norm_l2(a).alias("norm_l2"), A.norm_l1(a).alias("norm_l1"), A.norm_inf(a).alias("norm_inf")).collect()}
    for r in R.reductions(rows).collect():
        for k in ("min", "max", "argmin", "argmax", "norm_inf"):
            assert r[k] == left[r.signal_id][k]
        for k in ("mean", "norm_l2", "norm_l1"):
            assert r[k] == pytest.approx(left[r.signal_id][k])


@pytest.mark.parametrize("chunk", [3, 7, 1000])
def test_chunks_do_not_change_results(held, chunk):
    data, arrays, rows = held
    taps = [0.5, -1.0, 0.25]
    fir, total, steps, up = series(R.fir(rows, taps, chunk)), series(R.running_sum(rows, chunk)), series(R.diff(rows, chunk)), series(R.upsample(rows, 2, chunk))
    full, moving = series(R.convolve(rows, taps, chunk)), series(D.moving(rows, 3, chunk), "mean")
    for s, v in data.items():
        assert fir[s] == pytest.approx(np.convolve(v, taps)[: len(v)])
        assert full[s] == pytest.approx(np.convolve(v, taps))
        assert total[s] == pytest.approx(np.cumsum(v))
        assert steps[s][0] is None and steps[s][1:] == pytest.approx(np.diff(v))
        assert up[s][::2] == v and len(up[s]) == 2 * len(v)
        assert moving[s] == pytest.approx([np.mean(v[max(0, k - 2) : k + 1]) for k in range(len(v))])


def test_array_transforms(held):
    data, arrays, rows = held
    a, taps = F.col("samples"), F.array(F.lit(0.5), F.lit(-1.0), F.lit(0.25))
    got = {r[0]: r for r in arrays.select("signal_id", A.convolve(a, taps), A.convolve(a, taps, "same"), A.diff(a), A.running_sum(a), A.resample(a, 1.5), A.sig_sub(A.sig_add(a, a), a)).collect()}
    rowwise = series(R.resample(rows, 1.5))
    for s, v in data.items():
        k = np.array([0.5, -1.0, 0.25])
        assert got[s][1] == pytest.approx(np.convolve(v, k))
        assert got[s][2] == pytest.approx(np.convolve(v, k)[1 : 1 + len(v)])
        assert got[s][3] == pytest.approx(np.diff(v)) and got[s][4] == pytest.approx(np.cumsum(v))
        assert got[s][5] == pytest.approx(rowwise[s]) and got[s][6] == pytest.approx(v)


def test_lengths_must_match(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="LENGTH_MISMATCH: 2 and 1"):
        df.select(A.sig_add(F.col("a"), F.col("b"))).collect()
    assert df.select(A.sig_add(F.col("a"), F.col("b"), True).alias("r"), A.inner(F.col("a"), F.col("b"), True).alias("i")).first() == (None, None)
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0)], "signal_id long, idx long, sample double")
    with pytest.raises(Exception, match="LENGTH_MISMATCH"):
        R.pointwise(rows, rows.where("idx = 0"), lambda p, q: p + q).collect()
    grown = df.select(*[c for p in ("zeropad", "latch", "tile") for c in A.broadcast_pair(F.col("a"), F.col("b"), p)]).first()
    assert [grown[k] for k in (1, 3, 5)] == [[1.0, 0.0], [1.0, 1.0], [1.0, 1.0]]


def test_edges(spark):
    df = spark.createDataFrame([([], [3.0, 5.0, 5.0, 3.0], [0.0, 0.0], [1.0, math.nan])], "e array<double>, t array<double>, z array<double>, n array<double>")
    e, t, z, n = (F.col(k) for k in "etzn")
    r = df.select(A.minimum(e), A.argmax(e), A.mean(e), A.norm_l2(e), A.argmax(t), A.argmin(t), A.angle(z, z), A.maximum(n)).first()
    assert tuple(r)[:6] == (None, None, None, None, 1, 0) and math.isnan(r[6]) and math.isnan(r[7])


def test_spectra(held):
    data, _, rows = held
    first = rows.where("signal_id < 3 and idx < 16")
    spectrum = D.dft(first, 16, 16)
    fast = {(r.signal_id, r.k): (r.re, r.im) for r in D.fft(first).collect()}
    energy = {}
    for r in spectrum.collect():
        assert (r.re, r.im) == pytest.approx(fast[r.signal_id, r.k], abs=1e-9)
        energy[r.signal_id] = energy.get(r.signal_id, 0) + (r.re**2 + r.im**2) / 16
    for s, v in energy.items():
        assert v == pytest.approx(sum(x * x for x in data[s][:16]))
    back = series(D.inverse_dft(spectrum, 16))
    assert all(back[s] == pytest.approx(data[s][:16], abs=1e-9) for s in (1, 2))


def test_demodulation(spark):
    n, omega = 400, math.pi / 2
    rows = D.generate(spark, n, lambda i: D.iq(F.lit(0.7), F.lit(-0.2), omega, i)).withColumn("signal_id", F.lit(1))
    got = D.iq_demodulate(rows, omega, [0.25] * 4, chunk=50).where("idx > 10").agg(F.avg("i"), F.avg("q"), F.stddev("i")).first()
    assert got[0] == pytest.approx(0.7, abs=1e-6) and got[1] == pytest.approx(-0.2, abs=1e-6) and got[2] < 1e-6
    D.register_modulation("double", lambda s, w, i: 2 * s)
    assert "double" in D.MODULATIONS


def test_pipeline_tracks_rates(held):
    _, _, rows = held
    p = D.Pipeline(48000).decimate(4).upsample(2).fir([1.0])
    assert p.rate == 24000
    assert p.run(rows).where("signal_id = 1").count() == 20
    with pytest.raises(ValueError, match="rates differ"):
        D.mixed((p, rows), (D.Pipeline(48000), rows))


def test_stream_filter_equals_batch(spark, held, tmp_path):
    _, _, rows = held
    for k in range(3):
        rows.where((F.col("idx") >= 15 * k) & (F.col("idx") < 15 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    taps = [0.5, 0.25, 0.125]
    got = series(chunks.run_to_end(chunks.fir_stream(stream, taps), "fir_test", "append"))
    want = series(R.fir(rows, taps))
    assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_write_signals(held, tmp_path):
    _, _, rows = held
    tables.write_signals(rows, str(tmp_path / "out"), 2)
    assert rows.sparkSession.read.parquet(str(tmp_path / "out")).count() == rows.count()
