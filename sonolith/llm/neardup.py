"""Near duplicates among embeddings by binary codes of randomly rotated residuals.

Equal vectors form a class. Each class is placed in the list of its nearest centroid,
where the sign bits of its rotated residual are its code, stored with the residual's
norm and the factor that makes a code's inner product an unbiased estimate. It also
visits each list of a smaller number that may hold its neighbours: that lies no
farther from its own list than VISIT deviations of a neighbour's rotation allow. So
two vectors meet once at most. Where they meet, the estimate and its confidence bound
decide which pairs are computed again, exactly, and only those link.

A list's members are cut into blocks by their angle to the centroid. Two blocks so
near to it that all their pairs link by the triangle inequality are counted as sums,
two blocks whose angles differ too much are passed over, and only rows of the others
meet. So a dense list of near copies costs no comparison of all with all.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, and neither do vectors of different lengths; ids may
repeat or be null (each row counts, and a null id is least only among nulls); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonolith.llm.common import bounded_batches, join_one, stable
from sonolith.llm.jaccard import components

LEVEL = 0.9
#: Deviations of a neighbour's similarity to a list within which the list is visited, and of an estimate within which it isn't sure.
VISIT, SURE = 2.5, 5.0
#: Sample vectors a list, and bytes of the sample at most; rounds of the centroids.
PER_LIST, SAMPLE_BYTES, ROUNDS = 16, 1 << 26, 6
#: Rows of a block.
BLOCK = 1024
#: Angles this close to the limit are not decided by the triangle inequality.
MARGIN = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, safe from overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(13).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of a sample of unit vectors, by spherical means."""
    out = sample[:lists].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[k : k + 1024] @ out.T).argmax(1) for k in range(0, len(sample), 1024)])
        total = np.zeros_like(out)
        np.add.at(total, own, sample)
        size = np.sqrt((total * total).sum(1))
        good = size > 1e-9
        out[good] = total[good] / size[good, None]
    return out


def padded(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def encode(residual: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs of the rotated residuals (packed), their norms, and <code, unit residual>."""
    norm = np.sqrt((residual * residual).sum(1))
    turned = residual @ turn / np.maximum(norm, 1e-300)[:, None]
    fix = np.abs(turned).sum(1) / sqrt(turned.shape[1])
    return np.packbits(turned > 0, axis=1), norm, np.maximum(fix, 1e-9)


def visited(like: np.ndarray, own: np.ndarray, between: np.ndarray, level: float, dim: int) -> np.ndarray:
    """Which lists may hold neighbours: like is the similarity of rows to the centroids,
    between that of their own centroid to all. A neighbour at the level turns by its angle into
    a random direction, so its similarity to two centroids shifts by a share of their distance."""
    spread = sqrt(1 - level * level) / level * np.sqrt(np.maximum(0, 2 - 2 * between)) / sqrt(max(1, dim - 1))
    return like[np.arange(len(like)), own][:, None] - like <= VISIT * spread


def maybe(code: np.ndarray, norm: np.ndarray, fix: np.ndarray, near: np.ndarray, query: np.ndarray, centre: np.ndarray, turn: np.ndarray, level: float) -> np.ndarray:
    """Pairs (members by queries) whose inner product may reach the level, by the members'
    codes: <x, q> = <c, x> + <c, q> - 1 + |x - c| |q - c| <residuals' directions>, and the last
    is <code, direction of q - c> / fix without bias, with a bound of SURE deviations."""
    dim = len(centre)
    rest = query - centre
    size = np.sqrt((rest * rest).sum(1))
    turned = (rest @ turn / np.maximum(size, 1e-300)[:, None]).astype(np.float32)
    signs = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
    estimate = (signs @ turned.T) / (sqrt(dim) * fix[:, None])
    bound = SURE * np.sqrt(np.maximum(0, 1 - fix * fix)) / fix / sqrt(max(1, dim - 1)) + 1e-5
    scale = norm[:, None] * size[None, :]
    return near[:, None] + (query @ centre)[None, :] - 1 + scale * (estimate + bound[:, None]) >= level - 1e-6


def linked(a: np.ndarray, b: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], level: float) -> np.ndarray:
    """Which of the pairs reach the level exactly, in double precision."""
    out = np.zeros(len(pairs[0]), bool)
    for k in range(0, len(out), 1 << 16):
        x, y = pairs[0][k : k + (1 << 16)], pairs[1][k : k + (1 << 16)]
        out[k : k + (1 << 16)] = np.einsum("ij,ij->i", a[x], b[y]) >= level
    return out


def least_reached(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component under the edges (x, y)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _blocks(placed: DataFrame, block: int) -> DataFrame:
    """placed with `block`: its place among the list's members, or visitors, by angle."""
    cell = F.floor(F.col("angle") * 1000).cast("long").alias("cell")
    own = Window.partitionBy("list", "home")
    cells = placed.groupBy("list", "home", cell).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("all", F.sum("n").over(own)).withColumn("before", F.sum("n").over(own.orderBy("cell")) - F.col("n")).where(F.col("all") > block)
    rows = placed.withColumn("cell", F.floor(F.col("angle") * 1000).cast("long")).join(cells.select("list", "home", "cell", "n", "before"), ["list", "home", "cell"], "left")
    at = F.col("before") + F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / block)) * block
    return rows.withColumn("block", F.coalesce(F.floor(at / block), F.lit(0)).cast("int")).drop("cell", "n", "before")


def _meetings(rows: DataFrame, level: float) -> DataFrame:
    """Pairs of blocks (list, a of members, home and b of members or visitors) that may hold
    links, each with `sure`: all of its pairs are links."""
    most = acos(level)
    blocks = rows.groupBy("list", "home", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("key").alias("least"))
    blocks = stable(blocks, "neardup-blocks")
    a = blocks.where("home").select("list", *[F.col(c).alias(f"a_{c}") for c in ("block", "n", "weight", "low", "high", "least")])
    both = a.join(blocks, "list").where(~F.col("home") | (F.col("block") > F.col("a_block")) | (F.col("block") == F.col("a_block")) & (F.col("n") > 1))
    apart = F.greatest(F.col("low") - F.col("a_high"), F.col("a_low") - F.col("high"))
    both = both.where(apart <= most + MARGIN)
    return stable(both.withColumn("sure", F.col("a_high") + F.col("high") <= most - MARGIN).withColumn("pair", F.xxhash64("list", "a_block", "home", "block")), "neardup-meetings")


def _surely(rows: DataFrame, meetings: DataFrame) -> DataFrame:
    """(key, root, links) of the pairs of blocks that link as a whole."""
    sure = meetings.where("sure")
    same = F.col("home") & (F.col("block") == F.col("a_block"))
    one = sure.select("list", F.lit(True).alias("home"), F.col("a_block").alias("block"), F.col("weight").alias("gain"), F.col("least").alias("root"), same.alias("itself"))
    two = sure.where(~same).select("list", "home", "block", F.col("a_weight").alias("gain"), F.col("a_least").alias("root"), F.lit(False).alias("itself"))
    gains = one.unionByName(two).groupBy("list", "home", "block").agg(F.sum("gain").alias("gain"), F.min("root").alias("root"), F.max("itself").alias("itself"))
    members = rows.select("list", "home", "block", "key", "weight").join(gains, ["list", "home", "block"])
    members = members.select("key", "root", (F.col("gain") - F.when(F.col("itself"), F.col("weight")).otherwise(0)).alias("links"))
    return members.unionByName(sure.where(~same).select(F.col("a_least").alias("key"), F.col("least").alias("root"), F.lit(0).cast("long").alias("links")))


def links(classes: DataFrame, level: float = LEVEL, block: int = BLOCK) -> DataFrame:
    """(key, root, links) in parts: classes is (key, weight, vec array<double>), a row a key; links
    sums the weights of other classes that link, and root is one that the key reaches."""
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, dim = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    lists = max(1, min(int(sqrt(n)), SAMPLE_BYTES // (8 * dim * PER_LIST)))
    # A bounded sample sets the centroids; every row is indexed.
    first = classes.orderBy(F.xxhash64(F.lit(1), "key"), "key").limit(lists * PER_LIST).select("vec").toPandas()["vec"]
    made = centroids(unit(padded(list(first), dim)), lists) if len(first) else np.zeros((1, dim))
    held = spark.sparkContext.broadcast((made, made @ made.T if lists <= 4096 else None, rotation(dim)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, between, turn = held.value
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.iloc[k : k + 256]
                x = unit(padded(list(part["vec"]), dim))
                like = x @ made.T
                own = like.argmax(1)
                near = visited(like, own, made[own] @ made.T if between is None else between[own], level, dim)
                near &= np.arange(len(made))[None, :] < own[:, None]
                near[np.arange(len(x)), own] = True
                row, at = np.nonzero(near)
                home = at == own[row]
                code, norm, fix = encode(x[row] - made[at], turn)
                lengths = part["vec"].map(len).to_numpy(np.int64)
                yield pd.DataFrame({
                    "list": lengths[row] * (1 << 32) + at,
                    "home": home,
                    "key": part["key"].to_numpy(object)[row],
                    "weight": part["weight"].to_numpy(np.int64)[row],
                    "angle": np.arccos(np.clip(like[row, at], -1, 1)),
                    "vec": [x[r].tobytes() for r in row],
                    "code": [c.tobytes() if h else None for c, h in zip(code, home, strict=True)],
                    "norm": norm,
                    "fix": fix,
                })

    placed = classes.select("key", "weight", "vec").mapInPandas(place, "list long, home boolean, key string, weight long, angle double, vec binary, code binary, norm double, fix double")
    rows = stable(_blocks(stable(placed, "neardup-placed"), block), "neardup-rows")
    meetings = _meetings(rows, level)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, _, turn = held.value

        def work(group: pd.DataFrame) -> pd.DataFrame:
            x = np.frombuffer(b"".join(group["vec"]), np.float64).reshape(len(group), -1)
            centre, first = made[int(group["list"].iloc[0]) & 0xFFFFFFFF], group["first"].to_numpy(bool)
            a, b = np.flatnonzero(first), np.flatnonzero(group["second"].to_numpy(bool))
            members = group.iloc[a]
            code = np.frombuffer(b"".join(members["code"]), np.uint8).reshape(len(a), -1)
            near = maybe(code, members["norm"].to_numpy(), members["fix"].to_numpy(), np.cos(members["angle"].to_numpy()), x[b], centre, turn, level)
            if first[b].all():  # a block with itself: each pair once
                near = np.triu(near | near.T, 1)
            i, j = np.nonzero(near)
            i, j = a[i], b[j]
            good = linked(x, x, (i, j), level)
            i, j = i[good], j[good]
            weight, got = group["weight"].to_numpy(np.int64), np.zeros(len(group), np.int64)
            np.add.at(got, i, weight[j])
            np.add.at(got, j, weight[i])
            at = np.flatnonzero(got > 0)
            keys = group["key"].to_numpy(object)
            return pd.DataFrame({"key": keys[at], "root": keys[least_reached(len(group), i, j)[at]], "links": got[at]})

        held_rows: pd.DataFrame | None = None
        for batch in batches:
            held_rows = batch if held_rows is None else pd.concat([held_rows, batch], ignore_index=True)
            if not len(held_rows):
                continue
            pair = held_rows["pair"].to_numpy()
            ends = np.flatnonzero(pair[1:] != pair[:-1]) + 1
            for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True) if len(ends) else ():
                if hi - lo > 1:
                    yield work(held_rows.iloc[lo:hi])
            if len(ends):
                held_rows = held_rows.iloc[ends[-1] :]
        if held_rows is not None and len(held_rows) > 1:
            yield work(held_rows)

    same = F.col("home") & (F.col("block") == F.col("a_block"))
    unsure = meetings.where(~F.col("sure"))
    sides = unsure.select("list", F.lit(True).alias("home"), F.col("a_block").alias("block"), "pair", F.lit(True).alias("first"), same.alias("second"))
    sides = sides.unionByName(unsure.where(~same).select("list", "home", "block", "pair", F.lit(False).alias("first"), F.lit(True).alias("second")))
    met = rows.join(sides, ["list", "home", "block"]).select("pair", "list", "key", "weight", "angle", "vec", "code", "norm", "fix", "first", "second")
    found = met.repartition(parts, "pair").sortWithinPartitions("pair").mapInPandas(compare, "key string, root string, links long")
    return _surely(rows, meetings).unionByName(found)


def classes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", level: float = LEVEL, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: key, n_links (other rows at the level), component_id (least
    key that links reach), kept (whether that is its own)."""
    bounded_batches(vectors.sparkSession)
    v = F.col("vec")
    big = F.lit(float("inf"))
    good = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).alias("id"), F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vec"))
    rows = stable(rows.select("id", F.when(good, v).alias("vec"), F.when(good, F.concat(F.hex(F.xxhash64(v)), F.hex(F.xxhash64(F.lit(7), v)))).alias("key")), "neardup-vectors")
    reps = stable(rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("vec").alias("vec")), "neardup-classes")
    found = stable(links(reps.select("key", "weight", "vec"), level, block), "neardup-links")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
    known = reps.select("key", "least", "weight").join(counts, "key", "left").join(group, "key", "left")
    known = stable(known.select("key", "least", "weight", F.coalesce("root", "key").alias("root"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "neardup-known")
    names = stable(known.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "neardup-names")
    final = stable(join_one(known, names, "root", "members", known.count()).select("key", "weight", "component_id", "n_links"), "neardup-final")
    out = join_one(rows.where(F.col("key").isNotNull()).select("id", "key"), final, "key", "weight", rows.count()).select("id", "n_links", "component_id")
    out = out.unionByName(rows.where(F.col("key").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def report(vectors: DataFrame) -> DataFrame:
    return classes(vectors)
