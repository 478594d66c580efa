"""Collocations by contiguous pattern growth (PrefixSpan over phrases).

Words that are frequent in their language are counted first, then pairs of them; a
phrase grows only along frequent pairs. Each place where a frequent pair goes on is
an occurrence, projected with the words that may follow it to the task of its prefix,
equal ones counted before they are shuffled. A task holds its prefix's occurrences
once; growth passes pointers to them, extending each prefix to the right, depth
first. A prefix of too many different occurrences is extended by a word and dealt
again, so that no task holds a hot prefix. Scores, cuts and containment are joins of
the frequent phrases alone.

Words are known by 64-bit hashes of language and word until the report; which of them
are frequent is asked of a bitmap of fixed size, whose false answers cost time and
change no count.

Defined results: null text is empty, null lang is `und`; lower-casing is of A-Z
alone; repeated rows count again; an empty table gives no rows; ids and other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonolith.llm.common import BITMAP, bitmap, bounded_batches, has_bit, stable

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of a text and words of a stream that are worked on at a time; distinct words that a task counts or keeps.
STRETCH, STREAM, KEPT_WORDS = 1 << 20, 1 << 21, 1 << 18
#: Different occurrences of a prefix that one task holds.
SPLIT = 1 << 16
WORDS = [f"w{k}" for k in range(LONGEST)]
BREAK = b"\n"
_LINES = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", BREAK * 10)
_TOKEN = re.compile(rb"[^ \t\n]+|\n")
_BLANK = re.compile(rb"[ \t\n]")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes | None, stretch: int = STRETCH) -> Iterator[list[bytes]]:
    """Words and breaks of the whole text in order, some at a time."""
    text, at = (text or b"").lower().translate(_LINES), 0
    while at < len(text):
        end = at + stretch
        if end < len(text):
            blank = _BLANK.search(text, end)
            end = blank.start() if blank else len(text)
        yield _TOKEN.findall(text, at, end)
        at = end


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, word, n) in parts; a break stands for the sum over all words."""
    held: dict[str, Counter] = {}

    def flush() -> pd.DataFrame:
        out = []
        for lang, words in held.items():
            words.pop(BREAK, None)
            if words:
                out += [(lang, BREAK, sum(words.values())), *((lang, w, n) for w, n in words.items())]
        held.clear()
        return pd.DataFrame(out, columns=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            for toks in tokens(text):
                held.setdefault(lang, Counter()).update(toks)
                if sum(map(len, held.values())) > KEPT_WORDS:
                    yield flush()
    yield flush()


class _Ids(dict):
    """word -> its hash in a language (as Spark's xxhash64 of both), 0 for breaks and words that are not frequent."""

    def __init__(self, lang: str, bits: np.ndarray):
        self.seed, self.bits = xxhash.xxh64_intdigest(lang.encode(), 42), bits

    def __missing__(self, word: bytes) -> int:
        value = 0 if word == BREAK else xxhash.xxh64_intdigest(word, self.seed)
        slot = value & (BITMAP - 1)
        if not self.bits[slot >> 3] >> (slot & 7) & 1:
            value = 0
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


def _streams(batches: Iterator[pd.DataFrame], bits: np.ndarray) -> Iterator[np.ndarray]:
    """The ids of all texts, one after another. Streams overlap in LONGEST - 1 ids, so
    each place but the last LONGEST - 1 of a stream starts one of its windows."""
    ids: dict[str, _Ids] = {}
    held, n = [], 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            if lang not in ids:
                if len(ids) >= 16:
                    ids.clear()
                ids[lang] = _Ids(lang, bits)
            for toks in tokens(text):
                held.append(np.fromiter(map(ids[lang].__getitem__, toks), np.uint64, len(toks)))
                n += len(toks)
                if n >= STREAM:
                    done = np.concatenate(held)
                    yield done
                    held = [done[1 - LONGEST :]]
                    n = LONGEST - 1
            held.append(np.zeros(1, np.uint64))
    yield np.concatenate([*held, np.zeros(LONGEST - 1, np.uint64)])


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _ODD) ^ b
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def _distinct(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of different rows and how many are alike; rows of one hash that differ stay apart."""
    key = cols[0]
    for c in cols[1:]:
        key = _pair_hash(key, c)
    order = np.argsort(key)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in cols:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def _counted(cols: list[np.ndarray]) -> pd.DataFrame:
    at, n = _distinct(cols)
    # Rows of one first word follow each other, which shuffles with fewer bytes.
    order = np.argsort(cols[0][at], kind="stable")
    at, n = at[order], n[order]
    return pd.DataFrame({w: c[at].view(np.int64) for w, c in zip(WORDS, cols, strict=False)} | {"n": n})


def _long(names: list[str]) -> str:
    return ", ".join(f"{x} long" for x in names)


def _grow(windows: np.ndarray, n: np.ndarray, pointers: np.ndarray, depth: int, least: int, out: list) -> None:
    """Adds the frequent right extensions, by depth first, of the prefix of `depth` words
    that the windows at the pointers share, as (place of an occurrence, length, count)."""
    following = windows[pointers, depth]
    order = np.argsort(following, kind="stable")
    following, pointers = following[order], pointers[order]
    first = np.flatnonzero(np.append(True, following[1:] != following[:-1]))
    sums = np.add.reduceat(n[pointers], first)
    for k in np.flatnonzero((sums >= least) & (following[first] != 0)):
        own = pointers[first[k] : first[k + 1] if k + 1 < len(first) else None]
        out.append((own[0], depth + 1, sums[k]))
        if depth + 1 < windows.shape[1]:
            _grow(windows, n, own, depth + 1, least, out)


def _grown(depth: int, least: int):
    """Pattern growth over rows sorted by their prefix of `depth` words."""

    def found(windows: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        out: list[tuple[int, int, int]] = []
        same = (windows[1:, :depth] == windows[:-1, :depth]).all(1)
        for own in np.split(np.arange(len(windows)), np.flatnonzero(~same) + 1):
            if (total := n[own].sum()) >= least:
                if depth > 2:
                    out.append((own[0], depth, total))
                _grow(windows, n, own, depth, least, out)
        rows = []
        for at, length, total in out:
            row = np.append(windows[at], total)
            row[length:LONGEST] = 0
            rows.append(row)
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((0, LONGEST + 1), np.int64)
        for batch in batches:
            held = np.concatenate([held, batch[[*WORDS, "n"]].to_numpy(np.int64)])
            if not len(held):
                continue
            # The last prefix may go on in the next batch.
            new = np.flatnonzero((held[:, :depth] != held[-1, :depth]).any(1))
            cut = new[-1] + 1 if len(new) else 0
            if cut and (rows := found(held[:cut, :LONGEST], held[:cut, LONGEST])):
                yield pd.DataFrame(np.stack(rows), columns=[*WORDS, "n"])
            held = held[cut:]
        if len(held) and (rows := found(held[:, :LONGEST], held[:, LONGEST])):
            yield pd.DataFrame(np.stack(rows), columns=[*WORDS, "n"])

    return run


def grow(windows: DataFrame, least: int = LEAST, split: int = SPLIT) -> DataFrame:
    """Frequent phrases of three words and more, (w0 .. w4, n) with 0 beyond their ends,
    out of windows (w0 .. w4, n), whose first three words each are some."""
    parts = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest, found = windows, None
    for depth in range(2, LONGEST):
        prefix = WORDS[:depth]
        sizes = stable(rest.groupBy(*prefix).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")), f"phrases-prefixes-{depth}")
        hot = sizes.where(F.col("rows") > split)
        some = not hot.isEmpty()
        usual = rest.join(hot.select(*prefix), prefix, "left_anti") if some else rest
        usual = usual.repartition(parts, *prefix).sortWithinPartitions(*prefix)
        more = usual.mapInPandas(_grown(depth, least), f"{_long(WORDS)}, n long")
        if some and depth > 2:
            more = more.unionByName(hot.where(F.col("n") >= least).select(*prefix, *[F.lit(0).cast("long").alias(w) for w in WORDS[depth:]], "n"))
        found = more if found is None else found.unionByName(more)
        if not some:
            return found
        rest = stable(rest.join(hot.select(*prefix), prefix, "left_semi").where(F.col(WORDS[depth]) != 0), f"phrases-hot-{depth}")
    return found.unionByName(rest.groupBy(*WORDS).agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, id, n), with each language's sum under the word of a line break,
    and phrases (w array of ids, a) of two words and more: all that occur `least` times."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = _rows(docs, text, lang)
    counts = rows.mapInPandas(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stable(counts.where(F.col("n") >= least).withColumn("id", F.xxhash64("lang", "word")), "phrases-words")
    common = spark.sparkContext.broadcast(bitmap(words.where(F.col("word") != F.lit(BREAK)).select(F.pmod("id", F.lit(BITMAP)).alias("slot"))))

    def pairs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids in _streams(batches, common.value):
            a, b = ids[: 1 - LONGEST], ids[1 : len(ids) + 2 - LONGEST]
            both = (a != 0) & (b != 0)
            yield _counted([a[both], b[both]])

    pairs = rows.mapInPandas(pairs_of, f"{_long(WORDS[:2])}, n long").groupBy("w0", "w1").agg(F.sum("n").alias("n"))
    pairs = stable(pairs.where(F.col("n") >= least), "phrases-pairs")

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = (batch[w].to_numpy(np.int64).view(np.uint64) for w in ("w0", "w1"))
            yield pd.DataFrame({"slot": (_pair_hash(a, b) & np.uint64(BITMAP - 1)).astype(np.int64)})

    joined = spark.sparkContext.broadcast(bitmap(pairs.mapInPandas(slots, "slot long")))

    def windows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids in _streams(batches, common.value):
            good = (ids[:-1] != 0) & (ids[1:] != 0)
            at = np.flatnonzero(good)
            good[at] = has_bit(joined.value, _pair_hash(ids[at], ids[at + 1]))
            starts = np.flatnonzero(good[: len(ids) + 1 - LONGEST] & good[1 : len(ids) + 2 - LONGEST])
            cols, on = [ids[starts], ids[starts + 1]], np.ones(len(starts), bool)
            for k in range(2, LONGEST):
                on = on & good[starts + k - 1]
                cols.append(np.where(on, ids[starts + k], np.uint64(0)))
            yield _counted(cols)

    windows = rows.mapInPandas(windows_of, f"{_long(WORDS)}, n long").groupBy(*WORDS).agg(F.sum("n").alias("n"))
    longer = grow(stable(windows, "phrases-windows"), least, split)
    ids = F.filter(F.array(*WORDS), lambda x: x != 0)
    found = pairs.select(F.array("w0", "w1").alias("w"), F.col("n").alias("a")).unionByName(longer.select(ids.alias("w"), F.col("n").alias("a")))
    return words, stable(found, "phrases-found")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, split: int = SPLIT) -> DataFrame:
    """Each language's `top` phrases: lang, rank, phrase, a, l, r, n, score.

    The score of a cut is floor(1000 a n / (l r)), exact while 1000 a, n, l and r have 18 digits at
    most; a phrase has that of its lowest cut. Phrases inside a longer one as frequent are left out."""
    words, found = frequent(docs, text, lang, least, split)
    single = words.where(F.col("word") != F.lit(BREAK))
    facts = single.select(F.array("id").alias("w"), F.col("n").alias("f")).unionByName(found.select("w", F.col("a").alias("f")))
    size = F.size("w")
    inner = found.where(size > 2).select("w", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("length")).select("w", "a", "length", F.explode(F.sequence(F.lit(1), size - F.col("length") + 1)).alias("k"))
    inside = inner.groupBy(F.slice("w", F.col("k"), F.col("length")).alias("w")).agg(F.max("a").alias("longer"))
    kept = found.join(inside, "w", "left").where(F.coalesce(100 * F.col("longer") < 100 * F.col("a"), F.lit(True))).select("w", "a")
    of = words.where(F.col("word") == F.lit(BREAK)).select("lang", F.col("n").alias("n"))
    kept = kept.join(single.select(F.col("id").alias("first"), "lang"), F.get("w", F.lit(0)) == F.col("first")).join(of, "lang").drop("first")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumn("left", F.slice("w", F.lit(1), F.col("k"))).withColumn("right", F.slice("w", F.col("k") + 1, size - F.col("k")))
    cuts = cuts.join(facts.select(F.col("w").alias("left"), F.col("f").alias("l")), "left").join(facts.select(F.col("w").alias("right"), F.col("f").alias("r")), "right")
    cuts = cuts.withColumn("score", F.expr("(cast(1000 * a as decimal(18,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    scored = cuts.groupBy("lang", "w", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "w", "a", "n", "cut.l", "cut.r", "cut.score")
    # Those beyond the last rank, ties aside, need no text.
    ahead = stable(scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top).drop("place"), "phrases-ahead")
    text_of = single.select("id", F.col("word").cast("string").alias("word"))
    spelled = ahead.select("w", F.posexplode("w").alias("k", "id")).join(text_of, "id").groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = ahead.join(spelled, "w").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def report(docs: DataFrame) -> DataFrame:
    return collocations(docs)
