"""Join of near copies: Jaccard similarity of five-word shingle sets by chosen paths.

Documents with equal shingle sets form a class, and classes are joined. Each set is
embedded by minhash; in every run a bucket's path chooses coordinates, and its sets
are split on their values there. Buckets that are small, or so alike that a split
costs more than the comparisons it saves, or as deep as paths go, are compared in blocks where they are
large, so no bucket is gathered whole: first by sketches of a byte a coordinate, which
leave only members with a likely partner, then these by brute force of their whole
sets. A link is counted in the first bucket in
which its sets meet, without listing pairs. Runs repeat until a link at the threshold
is missed with less than 1 - RECALL; sketches lose one with less than SKETCH_LOSS.

Defined results: null text is empty; texts under five words have one shingle of all
their words; texts without words are copies of each other; ids may repeat or be null
(each row counts); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.llm.common import bounded_batches, columns, fresh, join_one, stable

SHINGLE, RECALL = 5, 0.999
#: Similarity 4/5: inter / union >= 4 / 5 when 9 * inter >= 4 * (sum of sizes).
LEVEL = 0.8
COORDINATES, SMALL, DEPTH, BLOCK = 64, 128, 4, 1024
SKETCH_LOSS = 1e-5
#: Comparisons of sketches that take about the time of one more row of a path.
PATH_COST = 128
BITMAP = 1 << 26
_WORD = re.compile(r"\w+")
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_ODD = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _M3) | np.uint64(1)
_PLACE = [np.uint64(int(mix(np.array([k + 101], np.uint64))[0]) | 1) for k in range(SHINGLE)]


#: Words whose hashes a task keeps.
KEPT_WORDS = 1 << 16


class _Hashes(dict):
    """word -> 64-bit hash, kept for the first KEPT_WORDS words."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


def shingles(text: str | None, hashes: dict) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, sorted."""
    found = _WORD.findall((text or "").lower())
    if not found:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(hashes.__getitem__, found)), np.uint64)
    if len(h) < SHINGLE:
        h = np.concatenate([h, np.full(SHINGLE - len(h), len(h), np.uint64)])
    n = len(h) - SHINGLE + 1
    return np.unique(mix(sum(h[k : k + n] * _PLACE[k] for k in range(SHINGLE))))


def signature(s: np.ndarray) -> np.ndarray:
    """Minima of the set under COORDINATES multiply-shift hashes."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(s), 8192):
        out = np.minimum(out, ((s[k : k + 8192, None] * _ODD) >> np.uint64(32)).min(0))
    return out.astype(np.uint32)


def least_matches(level: float = LEVEL, loss: float = SKETCH_LOSS) -> int:
    """Equal coordinates that two sets at the level have but for a chance of `loss`."""
    below, t = 0.0, 0
    while True:
        below += comb(COORDINATES, t) * level**t * (1 - level) ** (COORDINATES - t)
        if below >= loss:
            return t
        t += 1


def sketch(signs: np.ndarray) -> bytes:
    """The low bytes of the minima: unlike sets agree in one of 256."""
    return (signs & np.uint32(255)).astype(np.uint8).tobytes()


def digest(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def root_choices(level: float = LEVEL, recall: float = RECALL) -> list[tuple[int, int]]:
    """(run, coordinate) at the root: runs repeat until recall is met at the level,
    counting that half of the meetings may be lost on deeper paths."""
    out, run, missed = [], 0, 1.0
    rng = np.random.default_rng(7)
    while missed > 1 - recall:
        chosen = np.flatnonzero(rng.random(COORDINATES) < 1 / (level * COORDINATES))
        if not len(chosen):
            chosen = rng.integers(0, COORDINATES, 1)
        out += [(run, int(c)) for c in chosen]
        missed *= (1 - level / 2) ** len(chosen)
        run += 1
    return out


def split(paths: np.ndarray, signs: np.ndarray, level: float = LEVEL) -> tuple[np.ndarray, np.ndarray]:
    """Rows and new paths: each path chooses its coordinates, one at least."""
    luck = mix(paths[:, None] ^ (np.arange(COORDINATES, dtype=np.uint64) * _M3 + _M1))
    chosen = luck < np.uint64(int(2**64 / (level * COORDINATES)))
    none = ~chosen.any(1)
    chosen[none, luck[none].argmin(1)] = True
    row, c = np.nonzero(chosen)
    return row, mix(mix(paths[row] * _M3 + c.astype(np.uint64)) ^ signs[row, c].astype(np.uint64))


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None = None, columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections, a with b or with itself, over a few columns at a time."""
    rows = a + (b or [])
    if not sum(map(len, rows)):
        return np.zeros((len(a), len(b) if b else len(a)), np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    _, column, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    owner, column = owner[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(a), len(b) if b else len(a)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, [first, first + columns])
        m = np.zeros((len(rows), min(columns, int(column[-1]) + 1 - first)), np.float32)
        m[owner[lo:hi], column[lo:hi] - first] = 1
        out += m[: len(a)] @ (m[len(a) :] if b else m).T
    return out.astype(np.int64)


def brute_force(leaf: int, keys: list[bytes], weights: np.ndarray, sets: list[np.ndarray], leaves: list[np.ndarray], sides: np.ndarray | None) -> list[tuple[bytes, bytes, int]]:
    """(key, least key that it reaches here, linked documents first met here) of the
    linked members. sides: 0 or 1 where only pairs across two blocks are compared."""
    n = np.array([len(s) for s in sets])
    if sides is None:
        a = b = np.arange(len(keys))
    else:
        a, b = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        if not len(a) or not len(b):
            return []
    if len(keys) == 2:
        inter = np.array([[n[a[0]], np.intersect1d(sets[0], sets[1], assume_unique=True).size]])
        inter = np.array([[n[0], inter[0, 1]], [inter[0, 1], n[1]]]) if sides is None else inter[:, 1:]
    else:
        inter = overlaps([sets[k] for k in a], None if sides is None else [sets[k] for k in b])
    near = 9 * inter >= 4 * (n[a][:, None] + n[b][None, :])
    if sides is None:
        np.fill_diagonal(near, False)
    if not near.any():
        return []
    earlier = [x[x < leaf] for x in leaves]
    met = overlaps([earlier[k] for k in a], None if sides is None else [earlier[k] for k in b]) > 0
    fresh = near & ~met
    links = np.zeros(len(keys), np.int64)
    links[a] += fresh @ weights[b]
    if sides is not None:
        links[b] += weights[a] @ fresh
    full = near
    if sides is not None:
        full = np.zeros((len(keys), len(keys)), bool)
        full[np.ix_(a, b)] = near
        full |= full.T
    out, left = [], set(np.flatnonzero(full.any(1)).tolist())
    while left:
        seen = np.zeros(len(keys), bool)
        edge = np.zeros(len(keys), bool)
        edge[next(iter(left))] = True
        while edge.any():
            seen |= edge
            edge = full[edge].any(0) & ~seen
        group = np.flatnonzero(seen).tolist()
        least = min(keys[k] for k in group)
        out += [(keys[k], least, int(links[k])) for k in group]
        left -= set(group)
    return out


def likely(sketches: np.ndarray, sizes: np.ndarray, sides: np.ndarray | None, most: int = 1 << 14) -> np.ndarray:
    """Which members have a partner that may be at the level; sides as in `brute_force`."""
    a = b = np.arange(len(sketches))
    if sides is not None:
        a, b = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    out, least = np.zeros(len(sketches), bool), least_matches()
    if not len(a) or not len(b):
        return out
    step = max(1, most // len(b))
    for k in range(0, len(a), step):
        rows = a[k : k + step]
        if len(rows) * len(b) <= 1024:
            equal = (sketches[rows][:, None] == sketches[b][None]).sum(2)
        else:  # a coordinate at a time
            equal = np.zeros((len(rows), len(b)), np.uint8)
            for x, y in zip(sketches[rows].T, sketches[b].T, strict=True):
                equal += x[:, None] == y
        low, high = np.minimum(sizes[rows, None], sizes[None, b]), np.maximum(sizes[rows, None], sizes[None, b])
        near = (equal >= least) & (5 * low >= 4 * high)
        if sides is None:
            near[np.arange(len(rows)), rows] = False
        out[rows] |= near.any(1)
        out[b] |= near.any(0)
    return out


def _blocks(rows: DataFrame, parts: int) -> DataFrame:
    """Rows (leaf, n, key, ...) with their block `own`, once for each pair of blocks
    (bi, bj) of their leaf, sorted by (leaf, bi, bj) within partitions."""
    names = [c for c in rows.columns if c != "n"]
    rows = rows.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key", F.lit(11)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(*names, "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    return rows.repartition(parts, "leaf", "bi", "bj").sortWithinPartitions("leaf", "bi", "bj")


def _groups(batches: Iterator[pd.DataFrame], names: tuple[str, ...], work) -> Iterator[list]:
    """The results of work(place, rows) for each block pair, a list for each batch."""
    group, at = [], None
    for batch in batches:
        out = []
        for leaf, bi, bj, *rest in zip(*(batch[c] for c in ("leaf", "bi", "bj", *names)), strict=True):
            if at != (leaf, bi, bj):
                if len(group) > 1:
                    out += work(at, group)
                group, at = [], (leaf, bi, bj)
            group.append(rest)
        if out:
            yield out
    if len(group) > 1 and (out := work(at, group)):
        yield out


def _sides(at: tuple, own: tuple) -> np.ndarray | None:
    return None if at[1] == at[2] else np.array([0 if o == at[1] else 1 for o in own])


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(leaf, key) of the members with a likely partner."""

    def work(at: tuple, group: list) -> list:
        keys, sketches, sizes, own = zip(*group, strict=True)
        held = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, COORDINATES)
        return [(at[0], bytes(keys[k])) for k in np.flatnonzero(likely(held, np.array(sizes, np.int64), _sides(at, own)))]

    for out in _groups(batches, ("key", "sketch", "size", "own"), work):
        yield pd.DataFrame(out, columns=["leaf", "key"])


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Brute force of each block pair."""

    def work(at: tuple, group: list) -> list:
        keys, weights, sets, leaves, own = zip(*group, strict=True)
        return brute_force(at[0], [bytes(k) for k in keys], np.array(weights, np.int64), [np.frombuffer(s, np.uint32) for s in sets], [np.asarray(x, np.int64) for x in leaves], _sides(at, own))

    for out in _groups(batches, ("key", "weight", "held", "leaves", "own"), work):
        yield pd.DataFrame(out, columns=["key", "root", "links"])


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node -> least node of its component, for the nodes of the edges (u, v), by
    alternating large and small stars; every round is written to the shared folder.
    The number of rounds grows with the logarithm of the edges; RuntimeError beyond."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if not large:
            both = both.where("v < u")
        least = stable(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "jaccard-least")
        joined = join_one(both, least, "u", "n", 2 * e.count())
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u != m").select("u", F.col("m").alias("v")))
        return stable(out.distinct(), "jaccard-stars")

    now, before = stable(edges.select("u", "v").where("u != v").distinct(), "jaccard-edges"), None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = star(star(now, True), False)
    else:
        raise RuntimeError(f"the components are not settled after {rounds} rounds")
    return now.select(F.col("u").alias("key"), F.col("v").alias("root"))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, class_id (least key of its group of near copies),
    n_links (other rows at the threshold or above, copies included)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for batch in batches:
            sets = [shingles(t, hashes) for t in batch]
            signs = [signature(s) for s in sets]
            yield pd.DataFrame({"key": [digest(s) for s in sets], "size": [len(s) for s in sets], "sign": [s.tobytes() for s in signs], "sketch": [sketch(s) for s in signs]})

    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), F.pandas_udf(sign, "key binary, size long, sign binary, sketch binary")(text).alias("s")).select("id", "text_hash", "s.*")
    rows = stable(rows, "jaccard-rows")
    # The least text of a class stands for it; all its texts have one set.
    reps = stable(rows.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"), F.min("text_hash").alias("text_hash"), F.first("size").alias("size"), F.first("sign").alias("sign"), F.first("sketch").alias("sketch")), "jaccard-classes")
    kept = _met(reps)
    pairs = _blocks(kept.join(reps.select("key", "sketch", "size"), "key"), parts)
    alive = stable(pairs.mapInPandas(_sketched, "leaf long, key binary").distinct(), "jaccard-likely")
    alive = _first_of_equals(alive, alive.groupBy("leaf").agg(*_members()))
    lists = stable(alive.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("leaf", "n"))).alias("at")), "jaccard-lists")

    # A bitmap of fixed size lets each task pass over most texts without a likely partner.
    slot = F.pmod("text_hash", F.lit(BITMAP))
    wanted = lists.join(reps.select("key", "text_hash", "weight"), "key")
    maps = wanted.select(slot.alias("x")).groupBy(F.expr("x div 32768").alias("b")).agg(F.expr("bitmap_construct_agg(x % 32768)").alias("m"))
    bits = np.zeros(BITMAP // 8, np.uint8)
    for r in maps.collect():  # BITMAP / 32768 rows of 4 KB at most
        bits[r["b"] * 4096 : (r["b"] + 1) * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    held = spark.sparkContext.broadcast(bits)

    def sets(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        hashes, bits = _Hashes(), held.value
        for texts, marks in batches:
            at = marks.to_numpy(np.int64) % BITMAP
            out = []
            for t, likely_met in zip(texts, (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist(), strict=True):
                s = shingles(t, hashes) if likely_met else None
                out.append((None, None) if s is None else (digest(s), np.unique(s.astype(np.uint32)).tobytes()))
            yield pd.DataFrame(out, columns=["key", "held"])

    full = docs.select(F.pandas_udf(sets, "key binary, held binary")(text, F.xxhash64(text)).alias("s")).select("s.*").where("held is not null").groupBy("key").agg(F.first("held").alias("held"))
    each = full.join(wanted.select("key", "at", "weight"), "key")
    each = each.select("key", "held", "weight", F.col("at.leaf").alias("leaves"), F.explode("at").alias("a")).select("key", "held", "weight", "leaves", "a.leaf", "a.n")
    found = stable(_blocks(each, parts).mapInPandas(_compare, "key binary, root binary, links long"), "jaccard-links")
    return _labelled(rows, reps, found, key)


def _members() -> list:
    """The number of a leaf's members, and hashes of their set."""
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("one"), F.bit_xor(F.xxhash64("key", F.lit(3))).alias("two")]


def _first_of_equals(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """rows (leaf, key) with n, in the first only of the leaves with equal members."""
    first = leaves.groupBy("n", "one", "two").agg(F.min("leaf").alias("leaf")).select("leaf", "n")
    return rows.join(first, "leaf").select("leaf", "key", "n")


def _met(reps: DataFrame) -> DataFrame:
    """(leaf, key, n): the buckets to compare, by paths of at most DEPTH choices."""
    chosen = root_choices()

    def root(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                signs = np.stack([np.frombuffer(s, np.uint32) for s in batch["sign"]]).astype(np.uint64)
                paths = [mix(mix(np.full(len(batch), run * 1000 + c, np.uint64) * _M3) ^ signs[:, c]) for run, c in chosen]
                yield pd.DataFrame({"leaf": _signed(np.concatenate(paths)), "key": np.tile(batch["key"].to_numpy(object), len(chosen))})

    def deeper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 4096):
                part = batch.iloc[k : k + 4096]
                signs = np.stack([np.frombuffer(s, np.uint32) for s in part["sign"]])
                row, paths = split(part["leaf"].to_numpy(np.int64).view(np.uint64), signs)
                yield pd.DataFrame({"leaf": _signed(paths), "key": part["key"].to_numpy(object)[row], "parent": part["leaf"].to_numpy(np.int64)[row]})

    now = stable(reps.where("size > 0").select("key", "sign").mapInPandas(root, "leaf long, key binary"), "jaccard-paths-1")
    sizes = stable(now.groupBy("leaf").agg(*_members()).where("n > 1").withColumn("share", F.lit(0.0)), "jaccard-sizes-1")
    ready = leaves = None
    for depth in range(1, DEPTH + 1):
        met = join_one(now, sizes.select("leaf", "n", "share"), "leaf", "n", now.count())
        # A split makes n / LEVEL rows or more, and leaves share / LEVEL of the n * n / 2 comparisons.
        costly = (F.col("share") > 0) & (F.col("n") * (1 - F.col("share") / LEVEL) <= 2 * PATH_COST / LEVEL)
        done = F.lit(True) if depth == DEPTH else (F.col("n") <= SMALL) | costly
        found = [(met.where(done), sizes.where(done))]
        if depth < DEPTH:
            wide, large = sizes.where(~done), met.where(~done)
            split_ = large.select("leaf", "key").join(reps.select("key", "sign"), "key")
            more = stable(split_.mapInPandas(deeper, "leaf long, key binary, parent long").distinct(), f"jaccard-paths-{depth + 1}")
            below = stable(more.groupBy("leaf").agg(*_members(), F.first("parent").alias("parent")), f"jaccard-sizes-{depth + 1}")
            # A coordinate's buckets hold the share of the pairs that agree there, on average their
            # similarity. From LEVEL on, paths go on in as many comparisons as they save or
            # more, and lose some: such a bucket is compared as it is.
            alike = F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")
            shares = below.groupBy("parent").agg(alike.alias("alike")).join(wide.select(F.col("leaf").alias("parent"), "n"), "parent")
            shares = stable(shares.select("parent", (F.col("alike") / F.col("n")).alias("share")), f"jaccard-alike-{depth}")
            stay = shares.where(F.col("share") >= LEVEL).select("parent")
            leaf = stay.select(F.col("parent").alias("leaf"))
            found.append((large.join(leaf, "leaf", "left_semi"), wide.join(leaf, "leaf", "left_semi")))
            now = more.select("leaf", "key")  # the sizes leave out what stays with its parent
            # What the parent's members share stands for what the bucket's do, which is as much or more.
            sizes = below.where("n > 1").join(shares.where(F.col("share") < LEVEL), "parent").drop("parent")
        for rows, own in found:
            ready = rows if ready is None else ready.unionByName(rows)
            leaves = own if leaves is None else leaves.unionByName(own)
    return stable(_first_of_equals(ready.select("leaf", "key"), leaves), "jaccard-leaves")


def _labelled(rows: DataFrame, reps: DataFrame, found: DataFrame, key: str) -> DataFrame:
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
    known = reps.select("key", "least", "weight").join(links, "key", "left").join(group, "key", "left")
    known = stable(known.select("key", "least", "weight", F.coalesce("root", "key").alias("root"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "jaccard-known")
    names = known.groupBy("root").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("members"))
    final = stable(join_one(known, stable(names, "jaccard-names"), "root", "members", known.count()).select("key", "weight", "class_id", "n_links"), "jaccard-final")
    return join_one(rows.select("id", "key"), final, "key", "weight", rows.count()).select(F.col("id").alias(key), "class_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies, that of the least id; same columns.

    Rows are known by id and content. Rows alike in all columns are one row; only
    those are dealt again to drop the repeats.
    """
    row, n = fresh(docs, "__row"), fresh(docs, "__n")
    held = docs.withColumn(row, F.md5(F.to_json(F.struct(*columns(docs))).cast("binary")))
    found = classes(held.select(F.struct("doc_id", F.col(row).alias("row")).alias("id"), "text"), key="id")
    first = stable(found.where("id = class_id").groupBy(F.col("id.row").alias(row)).agg(F.count(F.lit(1)).alias(n)), "jaccard-first")
    kept = held.join(first, row)
    repeats = kept.where(F.col(n) > 1).dropDuplicates([row])
    return kept.where(F.col(n) == 1).unionByName(repeats).select(*columns(docs))


def report(docs: DataFrame) -> DataFrame:
    return classes(docs)
