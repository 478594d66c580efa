"""128-bit integers over their full range against Python's integers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sonolith.functions import wide as W

RANGES = {"i128": (-(1 << 127), (1 << 127) - 1), "u128": (0, (1 << 128) - 1)}


def edges(t):
    rng = random.Random(9)
    low, high = RANGES[t]
    out = {low, high, low + 1, high - 1, 0, 1, 10**38, (1 << 64) - 1, 1 << 64, (1 << 127) - 1}
    out |= {-x for x in list(out)} | {rng.randrange(low, high) >> rng.randrange(0, 128) for _ in range(2)}
    return sorted(x for x in out if low <= x <= high)


def bits(x):
    x &= (1 << 128) - 1
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return (signed(x >> 64), signed(x & (1 << 64) - 1))


def value(row, t):
    if row is None:
        return None
    x = (row[0] & (1 << 64) - 1) << 64 | row[1] & (1 << 64) - 1
    return x - (1 << 128) if t == "i128" and x >> 127 else x


def wrapped(x, t):
    x &= (1 << 128) - 1
    return x - (1 << 128) if t == "i128" and x >> 127 else x


@pytest.fixture(scope="module", params=["i128", "u128"])
def pairs(request, spark):
    t = request.param
    rows = [(str(a), str(b), bits(a), bits(b)) for a, b in itertools.product(edges(t), edges(t))]
    return t, spark.createDataFrame(rows, f"p string, q string, a {W.TYPE}, b {W.TYPE}").cache()


def test_arithmetic_and_order(pairs):
    t, df = pairs
    a, b = F.col("a"), F.col("b")
    ops = {"add": (W.add, lambda x, y: x + y), "sub": (W.sub, lambda x, y: x - y), "mul": (W.mul, lambda x, y: x * y)}
    columns = [f(a, b, t, mode).alias(f"{n}_{mode}") for n, (f, _) in ops.items() for mode in ("wrap", "try")]
    more = [W.less(a, b, t).alias("less"), W.equal(a, b).alias("equal"), W.minimum(a, b, t).alias("min"), W.maximum(a, b, t).alias("max"), W.bit_and(a, b).alias("and"), W.bit_or(a, b).alias("or"), W.bit_xor(a, b).alias("xor")]
    low, high = RANGES[t]
    for r in df.select("p", "q", *columns, *more).collect():
        x, y = int(r["p"]), int(r["q"])
        for n, (_, op) in ops.items():
            assert value(r[f"{n}_wrap"], t) == wrapped(op(x, y), t), (n, x, y)
            assert value(r[f"{n}_try"], t) == (op(x, y) if low <= op(x, y) <= high else None), (n, x, y)
        assert r["less"] == (x < y) and r["equal"] == (x == y)
        assert (value(r["min"], t), value(r["max"], t)) == (min(x, y), max(x, y))
        assert [value(r[n], t) for n in ("and", "or", "xor")] == [x & y, x | y, x ^ y]


def test_division(pairs):
    t, df = pairs
    low, high = RANGES[t]
    for r in df.where(F.pmod(F.xxhash64("p", "q"), F.lit(4)) == 0).select("p", "q", W.div_rem(F.col("a"), F.col("b"), t, "try").alias("d")).collect():
        x, y = int(r["p"]), int(r["q"])
        if y == 0:
            assert r["d"] is None
            continue
        q = abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
        assert value(r["d"]["r"], t) == x - q * y and value(r["d"]["q"], t) == (q if low <= q <= high else None)


def test_one_operand(pairs):
    t, df = pairs
    a = F.col("a")
    shifts = [0, 1, 31, 32, 63, 64, 65, 127]
    columns = [W.shift_left(a, F.lit(n)).alias(f"l{n}") for n in shifts] + [W.shift_right(a, F.lit(n), t).alias(f"r{n}") for n in shifts] + [W.rotate_left(a, F.lit(n)).alias(f"o{n}") for n in shifts]
    more = [W.to_text(a, t).alias("text"), W.from_text(F.col("p"), t).alias("parsed"), W.from_be_bytes(W.to_be_bytes(a)).alias("back"), W.to_be_bytes(a).alias("bytes"), W.count_ones(a).alias("ones"), W.bit_not(a).alias("not")]
    for r in df.select("p", *columns, *more).distinct().collect():
        x = int(r["p"])
        full = x & (1 << 128) - 1
        for n in shifts:
            assert value(r[f"l{n}"], t) == wrapped(x << n, t) and value(r[f"r{n}"], t) == x >> n
            assert value(r[f"o{n}"], t) == wrapped(full << n | full >> (128 - n), t)
        assert r["text"] == r["p"] and value(r["parsed"], t) == value(r["back"], t) == x
        assert bytes(r["bytes"]) == full.to_bytes(16, "big") and r["ones"] == full.bit_count() and value(r["not"], t) == wrapped(~x, t)


def test_nulls_texts_and_failures(spark):
    df = spark.createDataFrame([(None, 1), (bits(5), None), (bits(-7), 70)], f"a {W.TYPE}, n int")
    a = F.col("a")
    rows = df.select(W.add(a, a).alias("s"), W.mul(a, a).alias("m"), W.neg(a).alias("g"), W.signum(a).alias("i"), W.to_long(a).alias("l"), W.to_text(a).alias("t"), W.shift_left(a, F.col("n")).alias("h"), W.div_rem(a, W.from_long(F.lit(2))).alias("d")).collect()
    assert all(v is None for v in rows[0]) and rows[1]["h"] is None
    assert [rows[2]["i"], rows[2]["l"], rows[2]["t"], value(rows[2]["m"], "i128"), value(rows[2]["h"], "i128")] == [-1, -7, "-7", 49, -7 << 70]
    texts = spark.createDataFrame([("",), ("x1",), ("-",), (str(1 << 127),), ("9" * 41,), ("+007",), ("-170141183460469231731687303715884105728",), (None,)], "s string")
    assert [value(r[0], "i128") for r in texts.select(W.from_text(F.col("s"))).collect()] == [None, None, None, None, None, 7, -(1 << 127), None]
    for bad in (W.add(W.constant(RANGES["i128"][1]), W.constant(1)), W.mul(W.constant(1 << 127), W.constant(2), "u128"), W.shift_left(a, F.lit(128)), W.div_rem(a, W.constant(0))["q"]):
        with pytest.raises(Exception, match="overflow|beyond|zero"):
            df.where("a is not null").select(bad.alias("x")).collect()
