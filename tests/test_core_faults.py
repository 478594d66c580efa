"""Long filters, NaN, narrowed constants, 16-bit floats, wide integers, user functions."""

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonolith.functions import bits as B
from sonolith.functions import registry
from sonolith.functions import scalar as S
from sonolith.functions.numtypes import CONSTANTS
from sonolith.operators import arrays as A
from sonolith.operators import dsp as D
from sonolith.operators import rows as R
from sonolith.plans import graph as G


def signal(spark, samples, signal_id=1):
    return spark.createDataFrame([(signal_id, i, None if x is None else float(x)) for i, x in enumerate(samples)], "signal_id long, idx long, sample double")


def values(df, name="sample"):
    return [r[name] for r in df.orderBy("signal_id", "idx").collect()]


@pytest.mark.parametrize("chunk", [1, 7, 32, 1000])
def test_filters_longer_than_a_chunk(spark, chunk):
    x = np.arange(300) % 11 - 4.0
    taps = [1.0] * 100
    assert values(R.fir(signal(spark, x), taps, chunk)) == pytest.approx(np.convolve(x, taps)[:300])
    got = values(D.moving(signal(spark, x), 90, chunk), "mean")
    assert got == pytest.approx([x[max(0, k - 89) : k + 1].mean() for k in range(300)])


def test_argmax_takes_nan_in_both_forms(spark):
    x = [1.0, math.nan, 5.0, math.nan]
    row = R.reductions(signal(spark, x)).first()
    held = spark.createDataFrame([(x,)], "a array<double>").select(A.argmax(F.col("a")).alias("k")).first()
    assert math.isnan(row["max"]) and row["argmax"] == held["k"] == 1 and row["argmin"] == 0


@pytest.mark.parametrize("chunk", [2, 5, 1 << 16])
def test_latch_by_chunks(spark, chunk):
    a = [1.0, None, 3.0] + [None] * 9
    b = [None, 7.0]
    got = R.broadcast_join(signal(spark, a), signal(spark, b), "latch", chunk=chunk).orderBy("idx").collect()
    assert [r["a"] for r in got] == [1.0, 1.0] + [3.0] * 10
    assert [r["b"] for r in got] == [None] + [7.0] * 11


@pytest.mark.parametrize("factor", [0.1, 0.3, 0.999, 1.0, 1.7, 3.0])
@pytest.mark.parametrize("n", [1, 2, 9, 40])
def test_resample_by_rows_equals_arrays(spark, factor, n):
    x = np.sin(np.arange(n)).tolist()
    got = R.resample(signal(spark, x), factor, chunk=4).orderBy("idx").collect()
    want = spark.createDataFrame([(x,)], "a array<double>").select(A.resample(F.col("a"), factor).alias("a")).first()["a"]
    assert [r["idx"] for r in got] == list(range(len(want))) and [r["sample"] for r in got] == pytest.approx(want)


def test_narrow_constants(spark):
    narrow = lambda v: struct.unpack("<f", struct.pack("<f", v))[0]
    row = spark.range(1).select(*[S.constant(n, t).alias(f"{n}_{t}") for n in ("pi", "e", "tau", "digits", "epsilon") for t in ("f32", "f64")])
    kinds, got = dict(row.dtypes), row.first()
    assert kinds["pi_f32"] == kinds["tau_f32"] == "float" and kinds["pi_f64"] == "double" and kinds["digits_f32"] == "int"
    assert got["pi_f32"] == narrow(math.pi) != math.pi and got["e_f32"] == narrow(math.e) != math.e
    assert got["tau_f32"] == 2 * got["pi_f32"] and got["tau_f64"] == 2 * math.pi
    assert CONSTANTS["f32"].pi == got["pi_f32"]


def test_sixteen_bit_floats(spark):
    x = [0.0, -0.0, 1.0, 1 + 2**-11, 1 + 3 * 2**-11, 65504.0, 65519.0, 65520.0, -1e9, 6e-8, 2.9e-8, 3.1e-8, 1 / 3, math.inf, math.nan, 2**-14 * 0.999, 12345.678]
    half, brain = (spark.createDataFrame([(v,) for v in x], "x float").select(G.rounded(F.col("x"), t).alias("y")) for t in (G.Float(16), G.Float(16, True)))
    held = np.array(x, np.float32)
    with np.errstate(over="ignore"):
        assert [r["y"] for r in half.collect()] == pytest.approx(held.astype(np.float16).astype(float).tolist(), nan_ok=True, rel=0, abs=0)
    whole = held.view(np.uint32)
    cut = ((whole + 0x7FFF + (whole >> 16 & 1)) & 0xFFFF0000).astype(np.uint32).view(np.float32)
    cut[np.isnan(held)] = np.nan
    assert [r["y"] for r in brain.collect()] == pytest.approx(cut.astype(float).tolist(), nan_ok=True, rel=0, abs=0)


def test_wide_integers_as_bytes(spark):
    from decimal import Decimal

    x = [0, 1, -1, 2**64, -(2**100), 10**37, None]
    df = spark.createDataFrame([(None if v is None else Decimal(v),) for v in x], "x decimal(38,0)")
    got = df.select("x", B.to_be_bytes(F.col("x"), "i128").alias("b"), B.from_le_bytes(B.to_le_bytes(F.col("x"), "i128"), "i128").alias("again")).collect()
    assert [r["again"] for r in got] == [r["x"] for r in got]
    assert [None if r["b"] is None else int.from_bytes(r["b"], "big", signed=True) for r in got] == x


def test_graph_integers_logarithms_and_results(spark):
    x = G.Context()
    a, b = x.argument("a", G.Int(32)), x.argument("b", G.Float(64))
    df = spark.createDataFrame([(2**31 - 1, 0.0)], "a int, b double")
    assert df.select(*G.lower([x.call("ln", b)])).first()[0] == -math.inf
    with pytest.raises(Exception, match="(?i)overflow"):
        df.select(*G.lower([x.call("add", a, a)])).collect()
    dialect = G.Dialect("two", dict(G.STANDARD.ops))
    dialect.register("halves", G.Spec(1, lambda v: (v * 0.5, v + 0.5)))
    y = G.Context(dialect)
    op = y.build("halves", [y.argument("b", G.Float(64))], [G.Float(64), G.Float(64)])
    assert tuple(df.select(*G.lower([y.value(r) for r in op.results])).first()) == (0.0, 0.5)


def test_user_functions(spark):
    def plus(x: pd.Series) -> pd.Series:
        return x + 1

    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    def upto(n: int) -> Iterator[tuple[int]]:
        for k in range(n):
            yield (k,)

    try:
        twice = registry.register("twice_", "column", lambda x: x * 2)
        registry.register("plus_one_", "scalar", plus, "long")
        registry.register("spread_", "aggregate", spread, "double")
        registry.register("upto_", "table", upto, "k int")
        with pytest.raises(ValueError):
            registry.register("upto_", "table", upto, "k int")
        with pytest.raises(ValueError):
            registry.register("odd_", "column", plus, "long")
        registry.install(spark)
        spark.range(5).createOrReplaceTempView("five_")
        assert [r[0] for r in spark.sql("SELECT plus_one_(id) FROM five_ ORDER BY 1").collect()] == [1, 2, 3, 4, 5]
        assert spark.sql("SELECT spread_(id) FROM five_").first()[0] == 4.0
        assert [r[0] for r in spark.sql("SELECT k FROM upto_(3) ORDER BY k").collect()] == [0, 1, 2]
        assert [r[0] for r in spark.range(3).select(twice(F.col("id"))).collect()] == [0, 2, 4]
    finally:
        for name in ("twice_", "plus_one_", "spread_", "upto_"):
            registry.FUNCTIONS.pop(name, None)
