"""Registered queries of long and recursive signal operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonolith.operators import demodulate as M
from sonolith.operators import dynamics as L
from sonolith.operators import filters as I
from sonolith.operators import rows as R
from sonolith.operators import spectral as P
from sonolith.operators import tiles as T
from sonolith.plans.catalog import EVENTS, ORACLES, QUERIES, _typed, _typed_sql, c, query  # noqa: F401
from sonolith.sources.seekable import Store
from sonolith.sources.tables import event_signals, table
from sonolith.streaming import chunks, reorder

CASCADE = I.butterworth(4, 0.1)


def _recursion(cascade: list[I.Biquad], of: str) -> str:
    """y of two biquads by a recursive query, a sample a step."""
    (b0, b1, b2, a1, a2), (c0, c1, c2, d1, d2) = [[f"({v!r})::DOUBLE" for v in q] for q in cascade]
    return f"""WITH RECURSIVE e AS {of}, f AS (SELECT DISTINCT signal_id, -1::BIGINT AS idx, 0::DOUBLE AS y, 0::DOUBLE AS s1, 0::DOUBLE AS s2, 0::DOUBLE AS t1, 0::DOUBLE AS t2 FROM e
UNION ALL SELECT signal_id, idx, y, {b1} * x - {a1} * u + s2, {b2} * x - {a2} * u, {c1} * u - {d1} * y + t2, {c2} * u - {d2} * y
 FROM (SELECT *, {c0} * u + t1 AS y FROM (SELECT e.signal_id, e.idx, e.sample AS x, {b0} * e.sample + s1 AS u, s1, s2, t1, t2 FROM f JOIN e ON e.signal_id = f.signal_id AND e.idx = f.idx + 1)))
SELECT signal_id, idx, round(y, 6) + 0.0 AS sample FROM f WHERE idx >= 0"""


@query(_recursion(CASCADE, EVENTS))
def sig_iir(spark, d):
    """A Butterworth low-pass of four poles over each user's signal."""
    return I.iir(event_signals(spark, d), CASCADE, chunk=64, group=8).select("signal_id", "idx", (F.round("sample", 6) + 0.0).alias("sample"))


@query(f"""WITH e AS {EVENTS}, s AS (SELECT signal_id, n1 * ceil(length / n1)::BIGINT AS n FROM (SELECT signal_id, count(*) AS length, ceil(sqrt(count(*)))::BIGINT AS n1 FROM e GROUP BY signal_id)),
p AS (SELECT signal_id, n, unnest(range(n)) AS k FROM s)
SELECT signal_id, n, k::BIGINT AS k, round(sum(sample * cos(2 * pi() * (k * idx % n) / n)), 4) + 0.0 AS re, round(-sum(sample * sin(2 * pi() * (k * idx % n) / n)), 4) + 0.0 AS im FROM p JOIN e USING (signal_id) GROUP BY signal_id, n, k""")
def fft_long(spark, d):
    """The whole spectrum of each user's whole signal, split over columns and rows."""
    return P.fft_long(event_signals(spark, d)).select("signal_id", "n", "k", *[(F.round(x, 4) + 0.0).alias(x) for x in ("re", "im")])


@query(f"SELECT signal_id, idx::BIGINT AS idx, round(sample, 4) + 0.0 AS sample FROM {EVENTS}")
def fft_long_back(spark, d):
    """The long transform and its inverse give each sample back."""
    got = P.inverse_long(P.fft_long(event_signals(spark, d)))
    return got.join(event_signals(spark, d).select("signal_id", "idx"), ["signal_id", "idx"]).select("signal_id", "idx", (F.round("re", 4) + 0.0).alias("sample"))


@query(f"SELECT signal_id, (a.idx + b.idx)::BIGINT AS idx, round(sum(a.sample * b.sample), 4) + 0.0 AS sample FROM {_typed_sql('click')} a JOIN {_typed_sql('view')} b USING (signal_id) GROUP BY signal_id, a.idx + b.idx")
def sig_convolve_pair(spark, d):
    """Each user's clicks convolved with their views."""
    return P.convolve_pair(_typed(spark, d, "click"), _typed(spark, d, "view"), block=32).select("signal_id", "idx", (F.round("sample", 4) + 0.0).alias("sample"))


@query(f"""WITH w AS (SELECT signal_id, f::BIGINT AS frame, idx - (f + 1) * 8 + 16 AS pos, sample FROM (SELECT *, unnest([idx // 8, idx // 8 + 1]) AS f FROM {EVENTS}))
SELECT signal_id, frame, k::BIGINT AS k, round(sum(sample * sin(pi() * pos / 16) * cos(2 * pi() * k * pos / 16)), 4) + 0.0 AS re, round(-sum(sample * sin(pi() * pos / 16) * sin(2 * pi() * k * pos / 16)), 4) + 0.0 AS im
FROM w, range(9) t(k) GROUP BY signal_id, frame, k""")
def sig_stft(spark, d):
    """Spectra of frames of 16 samples that overlap by 8."""
    return P.stft(event_signals(spark, d), 16, 8).select("signal_id", "frame", "k", *[(F.round(x, 4) + 0.0).alias(x) for x in ("re", "im")])


@query(f"SELECT signal_id, idx::BIGINT AS idx, round(sample, 4) + 0.0 AS sample FROM {EVENTS}")
def sig_stft_back(spark, d):
    """Short-time spectra, overlapped and added, give each sample back."""
    rows = event_signals(spark, d)
    got = P.inverse_stft(P.stft(rows, 16, 8), 16, 8)
    return got.join(rows.select("signal_id", "idx"), ["signal_id", "idx"]).select("signal_id", "idx", (F.round("sample", 4) + 0.0).alias("sample"))


_SCALE, _REACH = 2 / 3 * 0.95, 24
_TAP = f"({_SCALE!r} * CASE WHEN x = 0 THEN 1 ELSE sin(pi() * {_SCALE!r} * x) / (pi() * {_SCALE!r} * x) END * CASE WHEN abs(x) >= {_REACH} THEN 0 ELSE 0.42 + 0.5 * cos(pi() * x / {_REACH}) + 0.08 * cos(2 * pi() * x / {_REACH}) END)"


@query(f"""WITH e AS {EVENTS}, n AS (SELECT signal_id, unnest(range(ceil(count(*) * 2 / 3)::BIGINT)) AS m FROM e GROUP BY signal_id),
t AS (SELECT phase, j, {_TAP}::DOUBLE AS w FROM (SELECT p AS phase, j, j - p / 2.0::DOUBLE AS x FROM range(2) a(p), range({1 - _REACH}, {_REACH + 1}) b(j))),
bank AS (SELECT phase, j, w / sum(w) OVER (PARTITION BY phase) AS w FROM t)
SELECT n.signal_id, m::BIGINT AS idx, round(sum(e.sample * w), 5) + 0.0 AS sample FROM n JOIN bank ON phase = m * 3 % 2 JOIN e ON e.signal_id = n.signal_id AND e.idx = m * 3 // 2 + j GROUP BY n.signal_id, m""")
def sig_resample_sinc(spark, d):
    """Two samples for three, through a windowed sinc that removes what would alias."""
    return P.resample_sinc(event_signals(spark, d), 2, 3).select("signal_id", "idx", (F.round(c("sample"), 5) + 0.0).alias("sample"))


@query(f"SELECT signal_id, idx::BIGINT AS idx, 0.5::DOUBLE * sample + 0.25::DOUBLE * coalesce(lag(sample, 1) OVER w, 0) + 0.125::DOUBLE * coalesce(lag(sample, 2) OVER w, 0) AS sample FROM {EVENTS} WINDOW w AS (PARTITION BY signal_id ORDER BY idx)")
def stream_fir_late(spark, d):
    """A causal filter over events that arrive up to two days late, in order of their time."""
    rows = table(spark, d, "events").select(c("user_id").cast("long").alias("signal_id"), c("ts").cast("timestamp").alias("ts"), c("event_id").cast("long").alias("tie"), c("value").alias("sample"))
    stream = reorder.arrivals(rows, chunks.shared_path(spark, "arrivals"), 6, "pmod(xxhash64(tie), 172800)", 172_800)
    return chunks.run_to_files(reorder.fir_late(stream, [0.5, 0.25, 0.125], "2 days"))


def _stored(spark, d) -> Store:
    """The event signals in a store, in two appends."""
    store, rows = Store(spark, chunks.shared_path(spark, "signals")), event_signals(spark, d)
    store.append(rows.where(c("idx") < 48), 0, chunk=16)
    store.append(rows.where(c("idx") >= 48), 1, chunk=16)
    return store


@query(f"SELECT signal_id, idx::BIGINT AS idx, sample, (idx >= 40)::INTEGER AS part FROM {EVENTS}")
def source_seek(spark, d):
    """A stored signal set read to index 40, and from there on."""
    store = _stored(spark, d)
    return store.seek(0, 40).withColumn("part", F.lit(0)).unionByName(store.seek(40).withColumn("part", F.lit(1)))


@query(f"SELECT signal_id, idx::BIGINT AS idx, sample FROM {EVENTS}")
def source_stream(spark, d):
    """A stored signal set followed as a stream of its appends."""
    return chunks.run_to_files(_stored(spark, d).follow())


#: Shares whose products don't end, so that no result lies between two rounded ones.
ATTACK, RELEASE = 1 / 3, 1 / 17
_DB = "greatest(-200, CASE WHEN sample = 0 THEN -200 ELSE 20 * log10(abs(sample)) END)"


def _smoothed(u: str, attack: float, release: float) -> str:
    """A level that rises at once and falls by its release, then smoothed by its attack, a sample a step."""
    return f"""WITH RECURSIVE e AS (SELECT signal_id, idx, sample, {u} AS u FROM {EVENTS}), f AS (SELECT DISTINCT signal_id, -1::BIGINT AS idx, 0::DOUBLE AS sample, 0::DOUBLE AS p, 0::DOUBLE AS y FROM e
UNION ALL SELECT signal_id, idx, sample, p, y + {attack!r}::DOUBLE * (p - y) FROM (SELECT e.signal_id, e.idx, e.sample, greatest(u, f.p + {release!r}::DOUBLE * (u - f.p)) AS p, y FROM f JOIN e ON e.signal_id = f.signal_id AND e.idx = f.idx + 1))
"""


@query(_smoothed("abs(sample)", ATTACK, RELEASE) + "SELECT signal_id, idx, round(y, 6) + 0.0 AS sample FROM f WHERE idx >= 0")
def sig_envelope(spark, d):
    """The peak envelope of each user's signal."""
    return L.envelope(event_signals(spark, d), ATTACK, RELEASE, chunk=64, group=8).select("signal_id", "idx", (F.round("sample", 6) + 0.0).alias("sample"))


@query(_smoothed(f"greatest(0, 0.75 * ({_DB} - 30))", ATTACK, RELEASE) + "SELECT signal_id, idx, round(sample * pow(10, (3 - y) / 20), 5) + 0.0 AS sample FROM f WHERE idx >= 0")
def sig_compress(spark, d):
    """Samples above 30 decibels go on by a quarter, and all are 3 decibels louder."""
    return L.compress(event_signals(spark, d), 30.0, 4.0, ATTACK, RELEASE, gain=3.0, chunk=64, group=8).select("signal_id", "idx", (F.round("sample", 5) + 0.0).alias("sample"))


_TAPS = "(SELECT k, CASE WHEN k % 2 = 0 THEN 0 ELSE 2 / (pi() * k) * (0.54 + 0.46 * cos(pi() * k / 8)) END AS w FROM range(-8, 9) t(k))"


@query(f"""WITH m AS (SELECT signal_id, idx, cos(1.25::DOUBLE * idx + 0.4 + 0.0005::DOUBLE * sample) AS x FROM {EVENTS}),
q AS (SELECT m.signal_id, m.idx + k AS idx, sum(x * w) AS q FROM m, {_TAPS} t GROUP BY m.signal_id, m.idx + k),
a AS (SELECT m.signal_id, m.idx, atan2(q, x) AS a FROM m JOIN q USING (signal_id, idx)),
u AS (SELECT signal_id, idx, a, coalesce(a - lag(a) OVER w, 0) AS step FROM a WINDOW w AS (PARTITION BY signal_id ORDER BY idx)),
o AS (SELECT signal_id, idx, a - 2 * pi() * sum(round(step / (2 * pi()))) OVER (PARTITION BY signal_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1.25::DOUBLE * idx AS p FROM u)
SELECT signal_id, idx::BIGINT AS idx, round((p - avg(p) OVER (PARTITION BY signal_id)) / 0.0005::DOUBLE, 3) + 0.0 AS sample FROM o""")
def carrier_pm_demod(spark, d):
    """Each user's signal on a carrier of unknown phase, and from its samples alone back."""
    sent = event_signals(spark, d).withColumn("sample", F.cos(1.25 * c("idx") + 0.4 + 0.0005 * c("sample")))
    return M.pm(sent, 1.25, 0.0005, half=8, chunk=32).select("signal_id", "idx", (F.round("sample", 3) + 0.0).alias("sample"))


@query(f"""WITH m AS (SELECT signal_id, idx, (1 + 0.001::DOUBLE * sample) * cos(1.25::DOUBLE * idx + 0.4) AS x FROM {EVENTS}),
q AS (SELECT m.signal_id, m.idx + k AS idx, sum(x * w) AS q FROM m, {_TAPS} t GROUP BY m.signal_id, m.idx + k)
SELECT m.signal_id, m.idx::BIGINT AS idx, round((sqrt(x * x + q * q) - 1) / 0.001::DOUBLE, 4) + 0.0 AS sample FROM m JOIN q USING (signal_id, idx)""")
def carrier_am_demod(spark, d):
    sent = event_signals(spark, d).withColumn("sample", (1 + 0.001 * c("sample")) * F.cos(1.25 * c("idx") + 0.4))
    return M.am(sent, 0.001, half=8, chunk=32).select("signal_id", "idx", (F.round("sample", 4) + 0.0).alias("sample"))


_MATRIX = "(SELECT vec_id AS row, i - 1 AS col, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i))"


def _matrix(spark, d):
    """All embeddings as one matrix, in tiles of 64 rows and 16 columns."""
    each = table(spark, d, "embeddings").select(F.lit(0).alias("array_id"), c("vec_id").alias("row"), F.posexplode(c("embedding").cast("array<double>")).alias("col", "x"))
    return T.from_elements(each, ["row", "col"], "x", (64, 16))


@query(f"SELECT a.col::BIGINT AS i, b.col::BIGINT AS j, round(sum(a.x * b.x), 6) + 0.0 AS value FROM {_MATRIX} a JOIN {_MATRIX} b USING (row) GROUP BY a.col, b.col")
def array_gram(spark, d):
    """The product of the transposed matrix of all embeddings with itself."""
    a = _matrix(spark, d)
    got = T.to_elements(T.matmul(T.transpose(a, (1, 0)), a), (16, 16))
    return got.select(c("index")[0].alias("i"), c("index")[1].alias("j"), (F.round("value", 6) + 0.0).alias("value"))


@query(f"SELECT row::BIGINT AS i, round(sum(x), 6) + 0.0 AS total, max(x) AS high, min(x) AS low FROM {_MATRIX} GROUP BY row")
def array_reduce(spark, d):
    """Sums, maxima and minima over the columns of the matrix of all embeddings."""
    a = _matrix(spark, d)
    one = lambda op, name: T.to_elements(T.reduce_axis(a, 1, op), (64,)).select(c("index")[0].alias("i"), c("value").alias(name))
    return one("sum", "total").join(one("max", "high"), "i").join(one("min", "low"), "i").select("i", (F.round("total", 6) + 0.0).alias("total"), "high", "low")


@query(f"SELECT signal_id, round(acos(greatest(-1, least(1, sum(a.sample * b.sample) / (sqrt(sum(a.sample * a.sample)) * sqrt(sum(b.sample * b.sample)))))), 9) + 0.0 AS angle, round(sum(a.sample * b.sample) / sum(b.sample * b.sample), 9) + 0.0 AS share FROM {EVENTS} a JOIN (SELECT signal_id, idx, sample + idx AS sample FROM {EVENTS}) b USING (signal_id, idx) GROUP BY signal_id")
def sig_angle_rows(spark, d):
    """The angle of two signals held as rows, and the share of the second that the first projects to."""
    rows = event_signals(spark, d)
    other = rows.withColumn("sample", c("sample") + c("idx"))
    share = R.project(rows, other).join(other.withColumnRenamed("sample", "b"), ["signal_id", "idx"]).where("b != 0").groupBy("signal_id").agg(F.max(c("sample") / c("b")).alias("share"))
    return R.angle(rows, other).join(share, "signal_id").select("signal_id", (F.round("angle", 9) + 0.0).alias("angle"), (F.round("share", 9) + 0.0).alias("share"))
