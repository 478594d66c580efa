"""128-bit integers over their full range, as two 64-bit limbs in one struct.

A value is STRUCT<high: BIGINT, low: BIGINT>: the halves of its two's complement, signed
(`i128`) or not (`u128`). All operators are JVM expressions over limbs of 32 or 16 bits
with carries, so nothing overflows on the way, whatever the session's overflow setting.
mode, as for the other integers: `wrap` keeps the low 128 bits, `try` gives NULL and
`strict` fails where the result doesn't fit. NULL operands give NULL; a division by zero
gives NULL with `try` and fails otherwise; shifts by less than 0 or 128 and more fail.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK16, MASK32, SIGN = 0xFFFF, 0xFFFFFFFF, -(1 << 63)
TEN38 = 10**38
TYPE = "struct<high:bigint,low:bigint>"


def _lit(x: int) -> Column:
    return F.lit(x).cast("bigint")


def of(high: Column, low: Column) -> Column:
    return F.when(high.isNotNull() & low.isNotNull(), F.struct(high.cast("bigint").alias("high"), low.cast("bigint").alias("low")))


def constant(value: int) -> Column:
    bits = value & (1 << 128) - 1
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return of(_lit(signed(bits >> 64)), _lit(signed(bits & (1 << 64) - 1)))


def from_long(x: Column) -> Column:
    x = x.cast("bigint")
    return of(F.shiftright(x, 63), x)


def to_long(x: Column) -> Column:
    """The value of an i128 as BIGINT; NULL where it doesn't fit."""
    return F.when(x["high"] == F.shiftright(x["low"], 63), x["low"])


def _limbs(x: Column, width: int) -> list[Column]:
    mask, each = (1 << width) - 1, 64 // width
    return [F.shiftrightunsigned(half, width * k).bitwiseAND(_lit(mask)) for half in (x["low"], x["high"]) for k in range(each)]


def _joined(limbs: list[Column], width: int) -> Column:
    each = 64 // width

    def half(part: list[Column]) -> Column:
        out = part[0]
        for k, limb in enumerate(part[1:], 1):
            out = out.bitwiseOR(F.shiftleft(limb, width * k))
        return out

    return of(half(limbs[each:]), half(limbs[:each]))


def _carried(columns: list[Column], width: int) -> list[Column]:
    """Sums of limbs with the carries of those below; the last carry goes."""
    out, carry = [], _lit(0)
    for c in columns:
        total = c + carry
        out.append(total.bitwiseAND(_lit((1 << width) - 1)))
        carry = F.shiftright(total, width)
    return out


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _checked(result: Column, fits: Column, mode: str, what: str) -> Column:
    if mode == "wrap":
        return result
    if mode == "try":
        return F.when(fits, result)
    return F.when(result.isNull() | fits, result).otherwise(F.raise_error(F.lit(f"{what} overflow")).cast(TYPE))


def negative(x: Column) -> Column:
    return x["high"] < 0


def _below(a: Column, b: Column) -> Column:
    """a < b as unsigned 64-bit numbers."""
    return a.bitwiseXOR(_lit(SIGN)) < b.bitwiseXOR(_lit(SIGN))


def less(a: Column, b: Column, t: str = "i128") -> Column:
    high = a["high"] < b["high"] if t == "i128" else _below(a["high"], b["high"])
    return high | (a["high"] == b["high"]) & _below(a["low"], b["low"])


def equal(a: Column, b: Column) -> Column:
    return (a["high"] == b["high"]) & (a["low"] == b["low"])


def minimum(a: Column, b: Column, t: str = "i128") -> Column:
    return F.when(less(b, a, t), b).otherwise(F.when(b.isNotNull(), a))


def maximum(a: Column, b: Column, t: str = "i128") -> Column:
    return F.when(less(a, b, t), b).otherwise(F.when(b.isNotNull(), a))


def bit_not(x: Column) -> Column:
    return of(F.bitwise_not(x["high"]), F.bitwise_not(x["low"]))


def bit_and(a: Column, b: Column) -> Column:
    return of(a["high"].bitwiseAND(b["high"]), a["low"].bitwiseAND(b["low"]))


def bit_or(a: Column, b: Column) -> Column:
    return of(a["high"].bitwiseOR(b["high"]), a["low"].bitwiseOR(b["low"]))


def bit_xor(a: Column, b: Column) -> Column:
    return of(a["high"].bitwiseXOR(b["high"]), a["low"].bitwiseXOR(b["low"]))


def _count(n: Column) -> Column:
    return F.when(n.isNull() | n.between(0, 127), n).otherwise(F.raise_error(F.lit("shift beyond 128 bits"))).cast("int")


def shift_left(x: Column, n: Column) -> Column:
    # Spark takes counts modulo 64: a shift by 64 - 0 is made in two steps.
    n = _count(n)
    over = F.call_function("shiftrightunsigned", F.shiftrightunsigned(x["low"], 1), F.lit(63) - n % 64)
    high = F.call_function("shiftleft", x["high"], n).bitwiseOR(over)
    low = F.call_function("shiftleft", x["low"], n)
    return F.when(n < 64, of(high, low)).otherwise(of(low, F.when(n.isNotNull(), _lit(0))))


def shift_right(x: Column, n: Column, t: str = "i128") -> Column:
    """Arithmetic for i128, logical for u128."""
    n = _count(n)
    name, fill = ("shiftright", F.shiftright(x["high"], 63)) if t == "i128" else ("shiftrightunsigned", _lit(0))
    over = F.call_function("shiftleft", F.shiftleft(x["high"], 1), F.lit(63) - n % 64)
    high = F.call_function(name, x["high"], n)
    low = F.call_function("shiftrightunsigned", x["low"], n).bitwiseOR(over)
    return F.when(n < 64, of(high, low)).otherwise(of(fill, F.when(n.isNotNull(), high)))


def _sum(a: Column, b: Column, more: int = 0) -> Column:
    columns = [x + y for x, y in zip(_limbs(a, 32), _limbs(b, 32), strict=True)]
    return _joined(_carried([columns[0] + more, *columns[1:]], 32), 32)


def add(a: Column, b: Column, t: str = "i128", mode: str = "strict") -> Column:
    def checked(r: Column) -> Column:
        fits = (negative(a) != negative(b)) | (negative(r) == negative(a)) if t == "i128" else ~less(r, a, t)
        return _checked(r, fits, mode, t)

    return _let(_sum(a, b), checked)


def sub(a: Column, b: Column, t: str = "i128", mode: str = "strict") -> Column:
    def checked(r: Column) -> Column:
        fits = (negative(a) == negative(b)) | (negative(r) == negative(a)) if t == "i128" else ~less(a, b, t)
        return _checked(r, fits, mode, t)

    return _let(_sum(a, bit_not(b), 1), checked)


def neg(x: Column, mode: str = "strict") -> Column:
    """-x of an i128; its least value has none."""
    return _checked(_sum(bit_not(x), constant(0), 1), ~equal(x, constant(-(1 << 127))), mode, "i128")


def size(x: Column) -> Column:
    """|x| of an i128, as u128."""
    return F.when(negative(x), neg(x, "wrap")).otherwise(x)


def signum(x: Column) -> Column:
    return F.when(negative(x), -1).when(equal(x, constant(0)), 0).when(x.isNotNull(), 1)


def mul(a: Column, b: Column, t: str = "i128", mode: str = "strict") -> Column:
    x, y = (size(a), size(b)) if t == "i128" else (a, b)

    def product(both: Column) -> Column:
        p, q = ([F.get(both[n], F.lit(k)) for k in range(8)] for n in ("x", "y"))
        columns = F.array(*[sum((p[i] * q[k - i] for i in range(max(0, k - 7), min(7, k) + 1)), _lit(0)) for k in range(15)], _lit(0))
        # A fold carries each sum once; nested expressions would compute those below again for each limb.
        start = F.struct(_lit(0).alias("carry"), F.array().cast("array<bigint>").alias("out"))

        def step(acc: Column, column: Column) -> Column:
            total = acc["carry"] + column
            return F.struct(F.shiftright(total, 16).alias("carry"), F.concat(acc["out"], F.array(total.bitwiseAND(_lit(MASK16)))).alias("out"))

        return F.aggregate(columns, start, step)["out"]

    def checked(limbs: Column) -> Column:
        whole = [F.get(limbs, F.lit(k)) for k in range(16)]
        value, beyond = _joined(whole[:8], 16), sum(whole[8:], _lit(0)) > 0
        if t == "u128":
            return _checked(value, ~beyond, mode, t)
        minus = negative(a) != negative(b)

        def signed(v: Column) -> Column:
            fits = ~beyond & (~negative(v) | minus & equal(v, constant(1 << 127)))
            return _checked(F.when(minus, neg(v, "wrap")).otherwise(v), fits, mode, t)

        return _let(value, signed)

    sizes = F.struct(x.alias("x"), y.alias("y"))
    some = _let(sizes, lambda v: F.struct(F.array(*_limbs(v["x"], 16)).alias("x"), F.array(*_limbs(v["y"], 16)).alias("y")))
    return F.when(a.isNotNull() & b.isNotNull(), _let(_let(some, product), checked))


def _short(x: Column) -> Column:
    """Whether an unsigned value has at most the 38 digits of a decimal."""
    return less(x, constant(TEN38), "u128")


def _dec(x: int) -> Column:
    return F.lit(str(x)).cast("decimal(38,0)")


def _decimal(x: Column) -> Column:
    """A short unsigned value as DECIMAL(38, 0)."""
    low = x["low"].cast("decimal(20,0)") + F.when(x["low"] < 0, _dec(1 << 64)).otherwise(_dec(0))
    return (x["high"].cast("decimal(19,0)") * _dec(1 << 64) + low).cast("decimal(38,0)")


def _from_decimal(d: Column) -> Column:
    low = d % _dec(1 << 64)
    return of(F.call_function("div", d, _dec(1 << 64)), F.when(low >= _dec(1 << 63), low - _dec(1 << 64)).otherwise(low).cast("bigint"))


def _divided_short(x: Column, y: Column) -> Column:
    """As `_divided`, of decimals: the quotient's digits above 20 first, since Spark's has 32 at most."""
    ten20 = _dec(10**20)
    rest = x % y
    top = (F.call_function("div", F.call_function("div", x, ten20).cast("decimal(38,0)"), y).cast("decimal(18,0)") * ten20).cast("decimal(38,0)")
    quotient = top + ((x - rest - (top * y).cast("decimal(38,0)")) / y).cast("decimal(38,0)")
    return _let(F.struct(quotient.cast("decimal(38,0)").alias("q"), rest.cast("decimal(38,0)").alias("r")), lambda v: F.struct(_from_decimal(v["q"]).alias("q"), _from_decimal(v["r"]).alias("r")))


def _divided(x: Column, y: Column) -> Column:
    """quotient and remainder of unsigned values, a bit a step."""
    start = F.struct(constant(0).alias("q"), constant(0).alias("r"))

    def step(acc: Column, k: Column) -> Column:
        # A bit of x at place n is that of its half at n modulo 64.
        half = F.when(k < 64, x["high"]).otherwise(x["low"])
        bit = F.call_function("shiftrightunsigned", half, F.lit(63) - k % 64).bitwiseAND(_lit(1))
        r = of(F.shiftleft(acc["r"]["high"], 1).bitwiseOR(F.shiftrightunsigned(acc["r"]["low"], 63)), F.shiftleft(acc["r"]["low"], 1).bitwiseOR(bit))
        q = of(F.shiftleft(acc["q"]["high"], 1).bitwiseOR(F.shiftrightunsigned(acc["q"]["low"], 63)), F.shiftleft(acc["q"]["low"], 1))
        # A remainder that lost its top bit is above any divisor.
        some = F.struct(q.alias("q"), r.alias("r"), negative(acc["r"]).alias("top"))

        def taken(v: Column) -> Column:
            more = F.struct(of(v["q"]["high"], v["q"]["low"].bitwiseOR(_lit(1))).alias("q"), _sum(v["r"], bit_not(y), 1).alias("r"))
            return F.when(v["top"] | ~less(v["r"], y, "u128"), more).otherwise(F.struct(v["q"].alias("q"), v["r"].alias("r")))

        return _let(some, taken)

    return F.aggregate(F.sequence(F.lit(0), F.lit(127)), start, step)


def div_rem(a: Column, b: Column, t: str = "i128", mode: str = "strict") -> Column:
    """STRUCT<q, r>: the quotient towards zero, and the remainder with a's sign. The least i128 by
    -1 doesn't fit."""
    zero = equal(b, constant(0))
    if mode != "try":
        b = F.when(zero, F.raise_error(F.lit("division by zero")).cast(TYPE)).otherwise(b)
    x, y = (size(a), size(b)) if t == "i128" else (a, b)

    def signed(d: Column) -> Column:
        if t == "u128":
            return d
        q = F.when(negative(a) != negative(b), neg(d["q"], "wrap")).otherwise(d["q"])
        fits = ~(equal(a, constant(-(1 << 127))) & equal(b, constant(-1)))
        return F.struct(_checked(q, fits, mode, t).alias("q"), F.when(negative(a), neg(d["r"], "wrap")).otherwise(d["r"]).alias("r"))

    def parts(v: Column) -> Column:
        both = _let(F.struct(_decimal(v["x"]).alias("x"), _decimal(v["y"]).alias("y")), lambda w: _divided_short(w["x"], w["y"]))
        return F.when(_short(v["x"]) & _short(v["y"]), both).otherwise(_divided(v["x"], v["y"]))

    return F.when(a.isNotNull() & b.isNotNull() & (~zero if mode == "try" else F.lit(True)), _let(_let(F.struct(x.alias("x"), y.alias("y")), parts), signed))


def to_text(x: Column, t: str = "i128") -> Column:
    """The decimal digits: 38 from a decimal, and the one before them by comparison."""

    def digits(v: Column) -> Column:
        out = F.when(_short(v), _decimal(v).cast("string"))
        for k in (3, 2, 1):
            rest = _decimal(_sum(v, constant(-k * TEN38))).cast("string")
            out = out.when(~less(v, constant(k * TEN38), "u128"), F.concat(F.lit(str(k)), F.lpad(rest, 38, "0")))
        return out

    value = size(x) if t == "i128" else x
    return F.when(x.isNotNull(), F.concat(F.when(negative(x), "-").otherwise("") if t == "i128" else F.lit(""), _let(value, digits)))


def from_text(s: Column, t: str = "i128") -> Column:
    """The value of decimal digits with an optional sign; NULL where they are none or don't fit."""
    digits = F.regexp_replace(F.ltrim(s), "^[+-]?0*(?=.)", "")
    padded = F.lpad(digits, 39, "0")
    lead = F.substring(padded, 1, 1)

    def whole(rest: Column) -> Column:
        out = F.when(lead == "0", _from_decimal(rest))
        for k in (1, 2, 3):
            out = out.when(lead == str(k), add(_from_decimal(rest), constant(k * TEN38), "u128", "try"))
        return out

    value = _let(F.substring(padded, 2, 38).cast("decimal(38,0)"), whole)
    good = s.rlike(r"^[+-]?\d+$" if t == "i128" else r"^\+?\d+$|^-0+$") & (F.length(digits) <= 39)

    def signed(v: Column) -> Column:
        minus = s.startswith("-")
        fits = ~negative(v) | minus & equal(v, constant(1 << 127))
        return F.when(fits, F.when(minus, neg(v, "wrap")).otherwise(v))

    return F.when(good, value if t == "u128" else _let(value, signed))


def to_be_bytes(x: Column) -> Column:
    text = lambda half: F.lpad(F.hex(half), 16, "0")
    return F.unhex(F.concat(text(x["high"]), text(x["low"])))


def from_be_bytes(b: Column) -> Column:
    four = lambda k: F.conv(F.substring(F.hex(b), 8 * k + 1, 8), 16, 10).cast("bigint")
    return _joined([four(3), four(2), four(1), four(0)], 32)


def count_ones(x: Column) -> Column:
    return F.bit_count(x["high"]) + F.bit_count(x["low"])


def rotate_left(x: Column, n: Column) -> Column:
    n = F.pmod(n, F.lit(128))
    return bit_or(shift_left(x, n), F.when(n == 0, constant(0)).otherwise(shift_right(x, F.lit(128) - F.when(n == 0, 1).otherwise(n), "u128")))
