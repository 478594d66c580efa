"""Recursive filters, long transforms, block convolution, short-time spectra and sinc resampling against plain numpy."""

import numpy as np
import pytest

from sonolith.operators import filters, spectral

SCHEMA = "signal_id long, idx long, sample double"
LENGTHS = {1: 1, 2: 17, 3: 1000, 4: 333, 5: 97}


def signals(lengths, seed=0):
    rng = np.random.default_rng(seed)
    return {k: rng.standard_normal(n) for k, n in lengths.items()}


def frame(spark, held):
    return spark.createDataFrame([(k, i, float(v)) for k, x in held.items() for i, v in enumerate(x)], SCHEMA).repartition(3)


def samples(df, value="sample", at="idx"):
    out = {}
    for r in df.collect():
        assert r[at] not in out.setdefault(r["signal_id"], {})
        out[r["signal_id"]][r[at]] = r[value]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def recursion(x, cascade):
    for b0, b1, b2, a1, a2 in cascade:
        y = np.zeros(len(x) + 2)
        z = np.concatenate([[0, 0], x])
        for n in range(2, len(y)):
            y[n] = b0 * z[n] + b1 * z[n - 1] + b2 * z[n - 2] - a1 * y[n - 1] - a2 * y[n - 2]
        x = y[2:]
    return x


CASCADE = [*filters.butterworth(5, 0.1), filters.peak(0.2, 6.0), filters.notch(0.3)]


@pytest.mark.parametrize(("chunk", "group"), [(16, 3), (7, 2), (1 << 14, 1 << 10)])
def test_iir(spark, chunk, group):
    held = signals(LENGTHS)
    got = samples(filters.iir(frame(spark, held), CASCADE, chunk, group))
    for k, x in held.items():
        assert np.allclose(got[k], recursion(x, CASCADE), atol=1e-12)


def test_iir_of_gaps_and_nulls(spark):
    x = signals({3: 1000})[3]
    rows = [(3, i, None if i % 7 == 0 else float(v)) for i, v in enumerate(x) if not 100 <= i < 400]
    got = {r["idx"]: r["sample"] for r in filters.iir(spark.createDataFrame(rows, SCHEMA), CASCADE, 16, 3).collect()}
    x[100:400], x[::7] = 0, 0
    want = recursion(x, CASCADE)
    assert set(got) == {i for _, i, _ in rows} and all(abs(got[i] - want[i]) < 1e-12 for i in got)
    assert filters.iir(spark.createDataFrame([], SCHEMA), CASCADE).count() == 0


def test_designs():
    gain = lambda cascade, f: abs(filters.response(cascade, f))
    for order in range(1, 7):
        for high in (False, True):
            cascade = filters.butterworth(order, 0.1, high)
            assert gain(cascade, 0.1) == pytest.approx(0.5**0.5)
            passed, stopped = (0.49, 0.01) if high else (0.01, 0.49)
            assert gain(cascade, passed) > 0.98 and gain(cascade, stopped) < 0.11**order
    assert gain([filters.notch(0.2)], 0.2) < 1e-12 and gain([filters.band_pass(0.2)], 0.2) == pytest.approx(1)
    assert gain([filters.peak(0.2, 6.0)], 0.2) == pytest.approx(10**0.3) and gain([filters.all_pass(0.2)], 0.37) == pytest.approx(1)
    assert gain([filters.one_pole(0.1)], 1e-9) == pytest.approx(1)
    with pytest.raises(ValueError):
        filters.low_pass(0.5)


def test_long_transform(spark):
    held = signals(LENGTHS)
    spectrum = spectral.fft_long(frame(spark, held))
    re, im = samples(spectrum, "re", "k"), samples(spectrum, "im", "k")
    for k, x in held.items():
        n = len(re[k])
        assert len(x) <= n <= len(x) + len(x) ** 0.5 + 1
        assert np.allclose(re[k] + 1j * im[k], np.fft.fft(x, n), atol=1e-10)
    back = samples(spectral.inverse_long(spectrum), "re")
    assert all(np.allclose(back[k][: len(x)], x, atol=1e-12) and np.allclose(back[k][len(x) :], 0, atol=1e-12) for k, x in held.items())


@pytest.mark.parametrize("block", [8, 32, 4096])
def test_convolution_of_two_signals(spark, block):
    a, b = signals(LENGTHS), signals({1: 5, 2: 40, 3: 700, 5: 97, 9: 3}, 1)
    got = samples(spectral.convolve_pair(frame(spark, a), frame(spark, b), block))
    assert set(got) == {1, 2, 3, 5}
    assert all(np.allclose(x, np.convolve(a[k], b[k]), atol=1e-10) for k, x in got.items())


@pytest.mark.parametrize(("size", "hop"), [(16, 8), (16, 4), (10, 3), (8, 8)])
def test_short_time_spectra(spark, size, hop):
    held = signals(LENGTHS)
    rows = frame(spark, held)
    window = np.ones(size) if hop == size else None
    spectra = spectral.stft(rows, size, hop, window)
    weights = spectral.root_hann(size) if window is None else window
    x = np.concatenate([np.zeros(size - hop), held[4], np.zeros(size)])
    got = {(r["frame"], r["k"]): complex(r["re"], r["im"]) for r in spectra.where("signal_id = 4").collect()}
    for f in range(max(k for k, _ in got) + 1):
        assert np.allclose([got[f, k] for k in range(size // 2 + 1)], np.fft.rfft(x[f * hop : f * hop + size] * weights), atol=1e-10)
    back = {(r["signal_id"], r["idx"]): r["sample"] for r in spectral.inverse_stft(spectra, size, hop, window).collect()}
    assert all(abs(back.get((k, i), 0.0) - v) < 1e-10 or i == 0 and (k, i) not in back for k, s in held.items() for i, v in enumerate(s))


@pytest.mark.parametrize(("up", "down"), [(3, 2), (2, 5), (4, 2), (1, 1)])
def test_sinc_resampling(spark, up, down):
    t = np.arange(400)
    held = {1: np.sin(2 * np.pi * 0.02 * t), 2: np.sin(2 * np.pi * 0.45 * t), 3: np.ones(400), 4: np.ones(1)}
    got = samples(spectral.resample_sinc(frame(spark, held), up, down))
    assert len(got[1]) == -(-400 * up // down) and len(got[4]) == -(-up // down)
    inner = slice(60 * up // down + 5, -60 * up // down - 5)
    assert np.abs(got[1] - np.sin(2 * np.pi * 0.02 * np.arange(len(got[1])) * down / up))[inner].max() < 1e-4
    assert np.abs(got[3][inner] - 1).max() < 1e-9
    if up < down:  # a tone above the new Nyquist rate goes, where picking samples would alias it
        assert np.abs(got[2][inner]).max() < 1e-4
