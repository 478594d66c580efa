"""Numeric functions over edge values, against Python arithmetic."""

import itertools
import math
import struct

import pytest
from pyspark.sql import functions as F

from sonolith.functions import bits as B
from sonolith.functions import scalar as S
from sonolith.functions.casts import PAIRS, checked_cast
from sonolith.functions.numtypes import CONSTANTS, TYPES, num

NAN, INF = math.nan, math.inf
EDGE = [NAN, INF, -INF, -0.0, 0.0, -0.4, 0.4, 2.5, -2.5, 1.0, -1.0, 0.49999999999999994, 1e300, -1e300, 5e-324, 2.0**52 + 1, 2.0**53, 2.0**63, -(2.0**63), 2.0**64, 18446744073709549568.0, 127.9, -128.9, 2147483647.5, -2147483648.9]


def same(got, want):
    if want is None or got is None:
        return got is want
    if isinstance(want, float) and math.isnan(want):
        return math.isnan(got)
    return got == want or isinstance(want, float) and math.isclose(got, want, rel_tol=1e-14)


@pytest.fixture(scope="module")
def pairs(spark):
    rows = list(itertools.product(EDGE, EDGE)) + [(None, 1.0), (1.0, None), (None, None)]
    return spark.createDataFrame(rows, "x double, y double").cache()


def check(df, expr, model, one=False):
    for r in df.select("x", "y", expr.alias("r")).collect():
        args = (r.x,) if one else (r.x, r.y)
        want = None if None in args else model(*args)
        assert same(r.r, want), (args, r.r, want)


def ieee_div(a, b):
    if b == 0:
        return NAN if a == 0 or math.isnan(a) else math.copysign(INF, a) * math.copysign(1, b)
    return a / b



@pytest.fixture(autouse=True, scope="module")
def names(spark):
    global x, y
    x, y = F.col("x"), F.col("y")


def test_float_arithmetic(pairs):
    check(pairs, S.div(x, y), ieee_div)
    check(pairs, S.rem(x, y), lambda a, b: NAN if b == 0 or math.isinf(a) else math.fmod(a, b))
    check(pairs, S.recip(x), lambda a: ieee_div(1.0, a), True)
    check(pairs, S.eq(x, y), lambda a, b: a == b)
    check(pairs, S.lt(x, y), lambda a, b: a < b)
    check(pairs, S.ge(x, y), lambda a, b: a >= b)
    check(pairs, S.minimum(x, y), lambda a, b: b if math.isnan(a) else a if math.isnan(b) else min(a, b))
    check(pairs, S.maximum(x, y), lambda a, b: b if math.isnan(a) else a if math.isnan(b) else max(a, b))
    check(pairs, S.clamp(x, F.lit(-1.0), F.lit(2.0)), lambda a: a if math.isnan(a) else max(-1.0, min(2.0, a)), True)


def test_sign_and_rounding(pairs):
    check(pairs, S.signum(x), lambda a: NAN if math.isnan(a) else math.copysign(1.0, a), True)
    check(pairs, S.is_negative(x), lambda a: not math.isnan(a) and math.copysign(1, a) < 0, True)
    whole = lambda f: lambda a: a if math.isnan(a) or math.isinf(a) else float(f(a))
    check(pairs, S.floor(x), whole(math.floor), True)
    check(pairs, S.ceil(x), whole(math.ceil), True)
    check(pairs, S.trunc(x), whole(math.trunc), True)
    check(pairs, S.rounded(x), whole(lambda a: math.copysign(math.floor(abs(a)) + (abs(a) % 1 >= 0.5), a)), True)
    check(pairs, S.fract(x), lambda a: NAN if math.isinf(a) else math.fmod(a, 1.0), True)


def test_powers_and_logarithms(pairs):
    def power(a, b):
        try:
            return math.pow(a, b)
        except OverflowError:
            return -INF if a < 0 and b % 2 == 1 else INF
        except ValueError:
            return INF * (math.copysign(1, a) if a == 0 and b % 2 == 1 else 1) if a == 0 else NAN

    check(pairs, S.power(x, y), power)
    log = lambda f: lambda a: NAN if math.isnan(a) or a < 0 else -INF if a == 0 else f(a)
    check(pairs, S.ln(x), log(math.log), True)
    check(pairs, S.log2(x), log(math.log2), True)
    check(pairs, S.log10(x), log(math.log10), True)
    check(pairs, S.ln_1p(x), lambda a: NAN if math.isnan(a) or a < -1 else -INF if a == -1 else math.log1p(a), True)
    got = pairs.limit(1).select(S.root(F.lit(-8.0), F.lit(3)).alias("a"), S.root(F.lit(8.0), F.lit(3)).alias("b")).first()
    assert math.isnan(got.a) and got.b == pytest.approx(2)


INTS = {"i8": "tinyint", "i32": "int", "i64": "bigint", "u8": "smallint", "u32": "bigint", "u64": "decimal(20,0)"}


def wrap(v, t):
    v %= 1 << t.bits
    return v - (1 << t.bits) if v > t.high else v


@pytest.mark.parametrize("name", INTS)
def test_integers(spark, name):
    t = num(name)
    values = sorted({t.low, t.low + 1, 0, 1, 2, 7, t.high - 1, t.high} | ({-7, -1} if t.kind == "i" else set()))
    df = spark.createDataFrame([(str(a), str(b)) for a in values for b in values], "a string, b string").select(F.col("a").cast(t.spark), F.col("b").cast(t.spark))
    a, b = F.col("a"), F.col("b")
    ops = {"add": lambda p, q: p + q, "sub": lambda p, q: p - q, "mul": lambda p, q: p * q}
    cols = [getattr(S, n)(a, b, t, m).alias(f"{n}_{m}") for n in ops for m in ("try", "wrap")]
    cols += [S.div(a, b, t, "try").alias("div"), S.rem(a, b, t, "try").alias("rem"), B.bit_xor(a, b, t).alias("xor"), B.bit_not(a, t).alias("inv"), B.shift_left(a, F.lit(3), t).alias("shl"), B.shift_right(a, F.lit(3), t).alias("shr"), B.to_be_bytes(a, t).alias("be"), B.from_le_bytes(B.to_le_bytes(a, t), t).alias("back"), B.to_bits(a, t).alias("bits")]
    for r in df.select(a, b, *cols).collect():
        p, q = int(r.a), int(r.b)
        get = lambda k: None if r[k] is None else int(r[k])  # noqa: E731, B023
        for n, f in ops.items():
            v = f(p, q)
            assert get(f"{n}_try") == (v if t.low <= v <= t.high else None) and get(f"{n}_wrap") == wrap(v, t)
        v = None if q == 0 else abs(p) // abs(q) * (1 if (p < 0) == (q < 0) else -1)
        assert get("div") == (v if v is not None and t.low <= v <= t.high else None) and get("rem") == (None if v is None else p - v * q)
        assert (get("xor"), get("inv"), get("shl"), get("shr")) == (wrap(p ^ q, t), wrap(~p, t), wrap(p << 3, t), p >> 3)
        assert bytes(r.be) == (p % (1 << t.bits)).to_bytes(t.bytes, "big") and get("back") == p and get("bits") == p % (1 << t.bits)
    for bad in (S.add(F.lit(t.high).cast(t.spark) if t.bits < 64 or t.kind == "i" else t.lit(t.high), S.one(t), t), S.div(S.one(t), S.zero(t), t), B.shift_left(S.one(t), F.lit(t.bits), t)):
        with pytest.raises(Exception, match="overflow|zero|shift"):
            df.limit(1).select(bad).collect()


def test_integer_roots_and_powers(spark):
    ns = [0, 1, 99, 100, 4503599761588224, 9223372030926249000, 2**63 - 1, 3037000499**2, 3037000499**2 - 1]
    for r in spark.createDataFrame([(n,) for n in ns], "n bigint").select("n", S.sqrt(F.col("n"), "i64").alias("r")).collect():
        assert r.r == math.isqrt(r.n)
    got = spark.range(1).select(S.power(F.lit(3), F.lit(5), "i32").alias("a"), S.power(F.lit(7), F.lit(0), "i32").alias("b"), S.power(F.lit(2), F.lit(40), "i32", "try").alias("c")).first()
    assert (got.a, got.b, got.c) == (243, 1, None)
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(S.sqrt(F.lit(-1), "i32")).collect()


@pytest.mark.parametrize("target", [t for t in TYPES if t[0] != "f"])
def test_float_casts(spark, target):
    t = num(target)
    df = spark.createDataFrame([(v,) for v in [*EDGE, -0.9, 255.9, None]], "x double")
    for r in df.select("x", checked_cast(x, "f64", t).alias("r")).collect():
        want = None
        if r.x is not None and math.isfinite(r.x):
            want = int(r.x) if t.low <= int(r.x) <= t.high and not (t.bits == 128 and abs(r.x) >= 1e37) else None
        assert (None if r.r is None else int(r.r)) == want, r


def test_all_pairs_cast(spark):
    assert len(PAIRS) == 196
    df = spark.range(1)
    for a, b in PAIRS:
        value = -1 if num(a).kind != "u" else 200
        want = None if num(b).kind == "u" and value < 0 else value if num(b).kind == "f" or num(b).low <= value <= num(b).high else None
        got = df.select(checked_cast(num(a).lit(value), a, b).alias("r")).first().r
        assert (None if got is None else int(got)) == want, (a, b)
    big = df.select(checked_cast(F.lit(16777217), "i32", "f32").alias("a"), checked_cast(F.lit(1e300), "f64", "f32").alias("b")).first()
    assert big.a == 16777216.0 and big.b == INF


def test_float_bits(spark):
    df = spark.createDataFrame([(v,) for v in EDGE if not math.isnan(v)], "x double")
    for r in df.select("x", B.to_bits(x, "f64").alias("b"), B.from_bits(B.to_bits(x, "f64"), "f64").alias("v"), B.to_be_bytes(x, "f64").alias("be"), B.to_bits(x.cast("float"), "f32").alias("f"), B.bulk_bits()(x).alias("fast")).collect():
        assert int(r.b) == struct.unpack(">Q", struct.pack(">d", r.x))[0] and struct.pack(">d", r.v) == struct.pack(">d", r.x) == bytes(r.be)
        assert r.fast == struct.unpack(">q", struct.pack(">d", r.x))[0]
        if abs(r.x) < 1e38:
            assert r.f == struct.unpack(">I", struct.pack(">f", r.x))[0]


def test_wide_bit_operators(spark):
    a, b = (1 << 127) + 5, (1 << 64) + 3
    df = spark.createDataFrame([(a.to_bytes(16, "big"), b.to_bytes(16, "big"), 3)], "a binary, b binary, n int")
    got = df.select(B.binary_op("xor")("a", "b").alias("x"), B.binary_op("left")("a", "n").alias("l"), B.binary_op("right")("a", "n").alias("r")).first()
    assert [int.from_bytes(bytes(v), "big") for v in got] == [a ^ b, (a << 3) % (1 << 128), a >> 3]


def test_constants():
    k = CONSTANTS["f64"]
    assert k.tau == 2 * k.pi and k.significand_mask | k.exponent_mask | (1 << 63) == (1 << 64) - 1
    assert struct.unpack("f", struct.pack("f", CONSTANTS["f32"].pi))[0] == struct.unpack("f", struct.pack("f", math.pi))[0]
    assert num("i8").least_positive == 0 and num("f64").least_positive == 2.2250738585072014e-308
