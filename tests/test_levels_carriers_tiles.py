"""Level dynamics, demodulation from a carrier alone, and tiled arrays against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.operators import demodulate, dynamics, tiles

SCHEMA = "signal_id long, idx long, sample double"


def frame(spark, held):
    return spark.createDataFrame([(k, i, float(v)) for k, x in held.items() for i, v in enumerate(x)], SCHEMA).repartition(3)


def samples(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["signal_id"], {})[r["idx"]] = r["sample"]
    return {k: np.array([v[i] for i in range(len(v))], float) for k, v in out.items()}


def smoothed(u, attack, release):
    out, p, y = np.zeros(len(u)), 0.0, 0.0
    for n, x in enumerate(u):
        p = max(x, (1 - release) * p + release * x)
        y = y + attack * (p - y)
        out[n] = y
    return out


@pytest.fixture(scope="module")
def held():
    rng = np.random.default_rng(6)
    return {k: rng.standard_normal(n) * np.repeat(rng.choice([0.01, 1.0, 5.0], n // 20 + 1), 20)[:n] for k, n in ((1, 1), (2, 17), (3, 900), (4, 333))}


@pytest.mark.parametrize(("chunk", "group"), [(16, 3), (7, 2), (4096, 64)])
def test_envelope(spark, held, chunk, group):
    got = samples(dynamics.envelope(frame(spark, held), 0.4, 0.02, chunk, group))
    assert all(np.allclose(got[k], smoothed(np.abs(x), 0.4, 0.02), atol=1e-12) for k, x in held.items())


def test_envelope_of_gaps(spark, held):
    x = held[3].copy()
    rows = [(3, i, float(v)) for i, v in enumerate(x) if not 50 <= i < 400]
    x[50:400] = 0
    level = smoothed(np.abs(x), 1.0, 0.02)
    level[50:400] = 0
    got = {r["idx"]: r["sample"] for r in dynamics.envelope(spark.createDataFrame(rows, SCHEMA), 0.4, 0.02, 16, 3).collect()}
    want = smoothed(level, 0.4, 1.0)
    assert len(got) == len(rows) and all(abs(v - want[i]) < 1e-12 for i, v in got.items())


def test_compressor_and_gate(spark, held):
    db = {k: 20 * np.log10(np.abs(x)) for k, x in held.items()}
    got = samples(dynamics.compress(frame(spark, held), -6.0, 4.0, 0.3, 0.01, knee=6.0, gain=2.0, chunk=16, group=3))
    for k, x in held.items():
        over = db[k] + 6
        less = np.where(over < -3, 0, np.where(np.abs(over) <= 3, 0.75 * (over + 3) ** 2 / 12, 0.75 * over))
        assert np.allclose(got[k], x * 10 ** ((2 - smoothed(less, 0.3, 0.01)) / 20), atol=1e-12)
    got = samples(dynamics.gate(frame(spark, held), -20.0, 0.3, 0.01, chunk=16, group=3))
    for k, x in held.items():
        less = np.where(db[k] < -20, np.minimum(80, 9 * (-20 - db[k])), 0)
        assert np.allclose(got[k], x * 10 ** (-smoothed(less, 0.3, 0.01) / 20), atol=1e-12)


def test_levels_of_silence_and_nothing(spark):
    got = samples(dynamics.compress(frame(spark, {1: [0.0, 0.0, 1.0]}), -6.0, 2.0, 1.0, 1.0))
    assert got[1][:2].tolist() == [0, 0] and got[1][2] == pytest.approx(10 ** (-3 / 20))
    assert dynamics.envelope(spark.createDataFrame([], SCHEMA), 0.5, 0.5).count() == 0
    with pytest.raises(ValueError):
        dynamics.Release(0.0)


def test_demodulation_without_knowing_the_carriers_phase(spark):
    n = np.arange(1500)
    message = np.sin(2 * np.pi * 0.004 * n) + 0.4 * np.cos(2 * np.pi * 0.009 * n)
    message -= message.mean()
    inner = slice(80, -80)
    for phase in (0.0, 1.1, -2.5):
        sent = {1: (1 + 0.5 * message) * np.cos(1.3 * n + phase)}
        got = samples(demodulate.am(frame(spark, sent), 0.5, chunk=128))
        assert np.abs(got[1] - message)[inner].max() < 0.02
        # A message of several turns, so that the angle has to be unwrapped over chunks.
        got = samples(demodulate.pm(frame(spark, {1: np.cos(1.3 * n + phase + 5 * message)}), 1.3, 5.0, chunk=128))
        off = (got[1] - message)[inner]
        assert np.abs(off - off.mean()).max() < 0.02 and abs(off.mean()) < 0.02
        got = samples(demodulate.fm(frame(spark, {1: np.cos(1.3 * n + phase + 0.2 * np.cumsum(message))}), 1.3, 0.2, chunk=128))
        assert np.abs(got[1] - message)[inner].max() < 0.05


def elements(df, tile):
    return {(r["array_id"], tuple(r["index"])): r["value"] for r in tiles.to_elements(df, tile).collect()}


def test_tiles(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((13, 7, 5))
    rows = spark.createDataFrame([(1, *(int(i) for i in at), float(v)) for at, v in np.ndenumerate(x)], "array_id long, i long, j long, k long, v double")
    held = tiles.from_elements(rows, ["i", "j", "k"], "v", (4, 3, 2))
    assert elements(held, (4, 3, 2)) == {(1, at): v for at, v in np.ndenumerate(x)}
    turned = tiles.transpose(held, (2, 0, 1))
    assert elements(turned, (2, 4, 3)) == {(1, at): v for at, v in np.ndenumerate(x.transpose(2, 0, 1))}
    for axis, tile in ((0, (3, 2)), (1, (4, 2)), (2, (4, 3))):
        for op, plain in (("sum", np.sum), ("max", np.max), ("min", np.min)):
            got = elements(tiles.reduce_axis(held, axis, op), tile)
            want = {(1, at): v for at, v in np.ndenumerate(plain(x, axis=axis))}
            assert set(got) == set(want) and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_matrix_products(spark):
    rng = np.random.default_rng(4)
    held = {1: (rng.standard_normal((11, 17)), rng.standard_normal((17, 6))), 2: (rng.standard_normal((1, 3)), rng.standard_normal((3, 9)))}

    def tiled(which, tile):
        rows = [(k, int(i), int(j), float(v)) for k, pair in held.items() for (i, j), v in np.ndenumerate(pair[which])]
        return tiles.from_elements(spark.createDataFrame(rows, "array_id long, i long, j long, v double"), ["i", "j"], "v", tile)

    got = elements(tiles.matmul(tiled(0, (4, 5)), tiled(1, (5, 2))), (4, 2))
    want = {(k, at): v for k, (a, b) in held.items() for at, v in np.ndenumerate(a @ b)}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_tiles_of_gaps_and_nulls(spark):
    rows = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 5, 3, 2.0), ("a", 5, 0, None)], "array_id string, i long, j long, v double")
    got = elements(tiles.from_elements(rows, ["i", "j"], "v", (4, 4)), (4, 4))
    assert {k: v for k, v in got.items() if v} == {("a", (0, 0)): 1.0, ("a", (5, 3)): 2.0}
    assert {k[1]: v for k, v in elements(tiles.reduce_axis(tiles.from_elements(rows, ["i", "j"], "v", (4, 4)), 0), (4,)).items()} == {(0,): 1.0, (1,): 0.0, (2,): 0.0, (3,): 2.0}
    assert tiles.from_elements(rows.where(F.lit(False)), ["i", "j"], "v", (4, 4)).count() == 0
