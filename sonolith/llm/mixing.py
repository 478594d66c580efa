"""Mixing of sources to target weights by cube-method balanced sampling.

Each source's target is met in expectation by whole repeats plus one more copy
with a fractional probability. The cube method's flight phase moves those
probabilities along the null space of the constraints (documents, tokens), three
open units at a time, until all but two of a bucket are 0 or 1. What is left over
of all buckets flies again, in fewer buckets, until each source has few open
documents: two, which may be large, and a ladder of documents of falling size that
do not fly. The landing settles those on an outcome near the target. A document too
long for such a landing is drawn before the last flight, and the others make up for it.
A source of few documents that still misses its target by more than NEAR changes the
copies of one or two of them at a time, between none and MAX_REPEATS; its documents so
give up their place in the number of documents for the tokens.

Defined results: null text has size 0; null sources form the last source; sizes
of 0 are never taken; repeated rows are mixed as rows of their own; an empty table
gives no rows. Reruns agree: every draw comes from hashes of the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonolith.llm.common import BLANKS, stable, whole

WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEATS = 3
#: Expected documents of a bucket in which probabilities fly together.
BUCKET = 1000
#: Share of a target by which a source may miss it before more than single copies change.
NEAR = 0.005
#: Documents of a source, each of half the size of the one before or less, kept for its landing.
LADDER = 12


def words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(f"[^{BLANKS}]+")).cast("long")


def targets(sizes: DataFrame, share: float = 1.0, weights=WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """source, source_size -> target. One row per source; its only window over all
    rows ranks sources, not documents.

    Sources that reach `most` times their size stop there. Ordered by size per
    weight, the capped ones come first: the first source whose share of what is
    left fits under its cap ends them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most))
    by_room = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("w"))
    final = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(everything)
    ranked = ranked.withColumn("final", final)
    return ranked.select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("final"))).alias("target"))


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase over the units in order; keeps sum(p) and sum(p * size); at most two stay open."""
    p = p.astype(float).copy()
    eps = 1e-9
    open_units: list[int] = []
    draws = rng.random(len(p) + 8)
    for k in range(len(p)):
        if not eps < p[k] < 1 - eps:
            p[k] = round(p[k])
            continue
        open_units.append(k)
        if len(open_units) < 3:
            continue
        a, b, c = open_units
        u = [size[b] - size[c], size[c] - size[a], size[a] - size[b]]
        if u[0] == u[1] == u[2] == 0:
            u = [1.0, -1.0, 0.0]
        own = (p[a], p[b], p[c])
        up = min((1 - x) / d if d > 0 else x / -d for x, d in zip(own, u, strict=True) if d)
        down = min(x / d if d > 0 else (1 - x) / -d for x, d in zip(own, u, strict=True) if d)
        step = up if draws[k] * (up + down) < down else -down
        for j, d in zip((a, b, c), u, strict=True):
            p[j] = min(1.0, max(0.0, p[j] + step * d))
            if p[j] < eps or p[j] > 1 - eps:
                p[j] = round(p[j])
        open_units = [j for j in open_units if 0 < p[j] < 1]
    return p


def ladder(size: np.ndarray) -> np.ndarray:
    """Places, in sizes that fall, of units for the landing: the first of at most
    half of the largest size, then each time the next of at most half of the last."""
    at, most = [], size[0] / 2 if len(size) else 0
    while len(at) < LADDER:
        k = int(np.searchsorted(-size, -most))
        if k >= len(size):
            break
        at.append(k)
        most = size[k] / 2
    return np.array(at, int)


def settle_heavy(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Draw the units, in sizes that fall, that no ladder below could balance, such as
    one very long document of a source. The tokens that a draw adds or takes are taken
    from or given to the units after it, in proportion; so tokens and the expected p
    are kept, and documents are not. Where only one outcome can be balanced, it is that."""
    p = p.copy()
    for k in range(len(p) - 1):
        if size[k:][ladder(size[k:])].sum() >= 0.8 * size[k]:
            break
        q, s, more, less = p[k + 1 :], size[k + 1 :], (1 - p[k]) * size[k], p[k] * size[k]
        down, up = float(q @ s), float((1 - q) @ s)
        if down > more and (up <= less or rng.random() < p[k]):
            p[k + 1 :], p[k] = q * (1 - more / down), 1.0
        elif up > less:
            p[k + 1 :], p[k] = 1 - (1 - q) * (1 - less / up), 0.0
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the open units: LADDER + 2 at most, so all outcomes are compared. Of those
    within half the smallest unit of the nearest to the expected tokens, the nearest
    to the expected documents is taken."""
    p = p.copy()
    at = np.flatnonzero((p > 0) & (p < 1))
    if not len(at):
        return p
    ways = np.arange(1 << len(at))[:, None] >> np.arange(len(at)) & 1
    off = ways - p[at]
    tokens, documents = np.abs(off @ size[at]), np.abs(off.sum(1))
    near = np.flatnonzero(tokens <= tokens.min() + size[at].min() / 2)
    p[at] = ways[near[np.lexsort((tokens[near], documents[near].round(9)))[0]]]
    return p


def repair(copies: np.ndarray, size: np.ndarray, miss: float, near: float, most: int = MAX_REPEATS) -> np.ndarray:
    """Copies (0 to most) changed for one or two units at a time until their tokens, which
    miss the expected ones by `miss`, do so by `near` at most or no change brings them
    nearer. For sources whose few units leave no near outcome of single copies."""
    copies = copies.copy()
    while abs(miss) > near:
        unit, step = (x.ravel() for x in np.meshgrid(np.arange(len(size)), np.concatenate([np.arange(-most, 0), np.arange(1, most + 1)]), indexing="ij"))
        good = (copies[unit] + step >= 0) & (copies[unit] + step <= most)
        unit, step = unit[good], step[good]
        if not len(unit):
            break
        gain = step * size[unit]
        order = np.argsort(gain, kind="stable")
        unit, step, gain = unit[order], step[order], gain[order]
        ways = [(abs(miss + gain[k]), abs(step[k]), (k,)) for k in [int(np.abs(miss + gain).argmin())]]
        # The second change that best makes up for each first one, on either side of the exact place.
        at = np.searchsorted(gain, -miss - gain)
        for shift in (-1, 0):
            other = np.clip(at + shift, 0, len(gain) - 1)
            off = np.where(unit[other] == unit, np.inf, np.abs(miss + gain + gain[other]))
            k = int(off.argmin())
            ways.append((off[k], abs(step[k]) + abs(step[other[k]]), (k, int(other[k]))))
        off, _, taken = min(ways)
        if off >= abs(miss):
            break
        for k in taken:
            copies[unit[k]] += step[k]
            miss += gain[k]
    return copies


def _flight(final: bool, held: int, near: float = NEAR):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "h", "p"], ascending=False).reset_index(drop=True)
        p, size = part["p"].to_numpy(float), part["size"].to_numpy(float)
        rng = np.random.default_rng([len(p), int(part["h"].iloc[0]) & 0xFFFFFFFF, int(part["h"].iloc[-1]) & 0xFFFFFFFF])
        flying, expected = np.ones(len(p), bool), float(p @ size)
        if final:
            p = settle_heavy(p, size, rng)
        if held:
            still = np.flatnonzero((p > 0) & (p < 1))
            flying[still[ladder(size[still])]] = False
        p[flying] = fly(p[flying], size[flying], rng)
        if not final:
            return part.assign(p=p)
        p = land(p, size)
        whole_copies = part["whole"].to_numpy(np.int64)
        copies = repair(whole_copies + np.round(p).astype(np.int64), size, float(p @ size) - expected, near * float(part["target"].iloc[0]))
        return part.assign(p=p, whole=copies - np.round(p).astype(np.int64))

    return run


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", share: float = 1.0, bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: key, size, source, source_size, target, copies, taken."""
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words(F.col(text)).alias("size"), F.xxhash64(F.col(key), F.col(source), F.col(text), F.lit(5)).alias("h"))
    rows = stable(rows, "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sources = sources.join(targets(sources.select("source", "source_size")).withColumnsRenamed({"source": "s2", "source_size": "n2"}), F.col("source").eqNullSafe(F.col("s2"))).drop("s2", "n2")
    sources = stable(sources, "mix-sources")
    few = sources.count() <= 100_000  # a checked size: each of these rows is a name and four numbers
    sources = sources.select(F.col("source").alias("s2"), "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("docs") / bucket)).alias("buckets"))
    rows = rows.join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(ratio + 1e-9)).withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), ratio - F.col("whole"))).otherwise(0.0))
    level, done = 0, None
    held = LADDER if bucket >= 4 * (LADDER + 2) else 0
    flying = rows.withColumn("bucket", F.pmod(F.col("h"), F.col("buckets")))
    while True:
        left = flying.where((F.col("p") > 0) & (F.col("p") < 1))
        largest = left.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        final = largest <= bucket
        if final:
            left = left.withColumn("bucket", F.lit(0).cast("long"))
        landed = left.groupBy("source", "bucket").applyInPandas(_flight(final, LADDER if final else held), ",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields))
        rest = flying.where(~((F.col("p") > 0) & (F.col("p") < 1)))
        done = rest if done is None else done.unionByName(rest)
        flying = stable(landed, f"mix-flight-{level}")
        if final:
            done = done.unionByName(flying)
            break
        level += 1
        # Two open documents and a ladder are left of each bucket at most: fewer buckets do next.
        flying = flying.withColumn("bucket", F.pmod(F.shiftright(F.col("h"), 7 * level), F.greatest(F.lit(1), F.ceil(F.col("buckets") * ((2 + held) / bucket) ** level))))
    copies = (F.col("whole") + F.when(F.col("p") >= 0.5, 1).otherwise(0)).cast("long")
    return done.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
