"""Benchmark decontamination by spaced seeds (DataFrame functions only).

A seed hashes the tokens at a mask's ones and ignores those at its zeros, so a
substituted word breaks only some seeds. Seeds of the benchmark join those at every
position of every text; around each hit the aligned tokens are compared, and a
document is contaminated if most of them agree.

Defined results: null or empty texts and items match nothing; items shorter than
the masks are sought whole, by a contiguous seed of their length; repeated rows of
one id and text are one result; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.llm.common import columns, fresh, stable, whole

MASKS = ("1101001011", "1011010011", "1100110101")
SPAN = 10
WINDOW, LEAST_WINDOW, LEAST_SHARE = 20, 13, 0.8
#: Seeds of the benchmark that are broadcast at once, of 40 bytes each whatever the length
#: of the items; more go in blocks, and beyond so many blocks both sides are shuffled.
BROADCAST_SEEDS, BLOCKS = 1_000_000, 16


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(whole(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _seeds(toks: Column, at: Column, masks: tuple[str, ...]) -> Column:
    """Hashes of all masks at a position; null where a mask runs over the end."""
    out = []
    for k, mask in enumerate(masks):
        picked = [F.get(toks, at + j) for j, bit in enumerate(mask) if bit == "1"]
        out.append(F.when(at + len(mask) <= F.size(toks), F.xxhash64(F.lit(k), *picked)))
    return F.array(*out)


def _again(toks: Column, at: Column) -> Column:
    """Whether one word fills the masks at a position and at the one before, whose seeds are
    then the same. Most texts end the comparison at its first pair of words."""
    return F.coalesce(reduce(lambda x, y: x & y, [F.get(toks, at + j - 1) == F.get(toks, at + j) for j in range(SPAN)]), F.lit(False))


def _hits(same: Column) -> Column:
    """The seeds that agree within an alignment; an item shorter than the masks agrees whole."""
    at = lambda i: sum((reduce(lambda x, y: x * y, [F.get(same, i + j) for j, bit in enumerate(mask) if bit == "1"]) for mask in MASKS), F.lit(0))
    many = F.aggregate(F.sequence(F.lit(0), F.size(same) - SPAN), F.lit(0).cast("long"), lambda n, i: n + at(i))
    return F.when(F.size(same) >= SPAN, many).otherwise(F.lit(1).cast("long"))


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", broadcast_seeds: int = BROADCAST_SEEDS, most_blocks: int = BLOCKS) -> DataFrame:
    """doc_id, text_hash, item_id, matched (share of equal tokens in the best window), hits; one row per pair.

    A benchmark of at most broadcast_seeds * most_blocks seeds is broadcast in blocks
    of that size; a larger one is joined by a shuffle of the seeds of both sides. The
    items themselves join what is left once hits are grouped by alignment. Where one word
    repeats in a text and in an item, only hits at the first place of either run are made: they have every alignment of the two runs, in number the sum
    of their lengths and not the product.
    """
    items = benchmark.select(F.col(item_key).alias("item_id"), tokens(F.col(item_text)).alias("item")).where(F.size("item") > 0)
    items = stable(items.select(F.xxhash64("item_id", "item").alias("own"), "item_id", "item").distinct(), "items")
    short = sorted(r[0] for r in items.select(F.size("item").alias("n")).where(F.col("n") < SPAN).distinct().collect())
    masks = (*MASKS, *("1" * n for n in short))
    seeds = items.withColumn("j", F.explode_outer(F.sequence(F.lit(0), F.size("item") - 1)))
    # A contiguous mask stands for whole items of its length only.
    whole_only = F.array(*[F.lit(len(m)) if k >= len(MASKS) else F.lit(0) for k, m in enumerate(masks)])
    seeds = seeds.select("own", F.size("item").alias("n"), "j", F.posexplode(_seeds(F.col("item"), F.col("j"), masks)).alias("k", "seed"), _again(F.col("item"), F.col("j")).alias("again")).where(F.col("seed").isNotNull() & ((F.get(whole_only, "k") == 0) | (F.get(whole_only, "k") == F.col("n"))))
    # A text's first place of a run meets all of an item's, its others only the item's first.
    meets = F.explode(F.when(F.col("again"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))
    seeds = stable(seeds.select("seed", meets.alias("again"), "own", "n", "j").distinct(), "seeds")
    blocks = max(1, -(-seeds.count() // broadcast_seeds))
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), tokens(F.col(text)).alias("toks"))
    least = min(map(len, masks))
    at = rows.withColumn("i", F.explode_outer(F.when(F.size("toks") >= least, F.sequence(F.lit(0), F.size("toks") - least)))).where("i is not null")
    at = at.withColumn("again", _again(F.col("toks"), F.col("i")))
    at = at.withColumn("seed", F.explode_outer(_seeds(F.col("toks"), F.col("i"), masks))).where("seed is not null")
    shift = (F.col("i") - F.col("j")).alias("shift")
    # Only the aligned part of a text goes on; hits of one alignment meet before they are verified.
    low, high = F.greatest(F.lit(0), F.col("shift")), F.least(F.size("toks"), F.col("shift") + F.col("n"))
    part = F.slice("toks", low + 1, high - low).alias("part")
    alignment = ("doc_id", "text_hash", "own", "n", "shift")
    if blocks <= most_blocks:
        block = lambda b: seeds if blocks == 1 else seeds.where(F.pmod("seed", F.lit(blocks)) == b)
        hits = reduce(DataFrame.unionByName, [at.join(F.broadcast(block(b)), ["seed", "again"]) for b in range(blocks)])
        hits = hits.select("doc_id", "text_hash", "own", "n", "toks", shift).select(*alignment, part)
        lines = hits.groupBy(*alignment).agg(F.first("part").alias("part"))
    else:
        hits = at.select("doc_id", "text_hash", "i", "seed", "again").join(seeds, ["seed", "again"]).select("doc_id", "text_hash", "own", "n", shift)
        lines = stable(hits.distinct(), "alignments")
        hit = lines.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
        alike = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
        texts = rows.join(hit, alike, "left_semi").groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.first("toks").alias("toks"))
        lines = lines.join(texts, alike).select(*alignment, part)
    lines = lines.join(items, "own").drop("own", "n")
    item = F.slice("item", F.greatest(F.lit(1), 1 - F.col("shift")), F.size("part"))
    same = F.transform(F.zip_with(item, "part", lambda x, y: x == y), lambda x: x.cast("int"))
    lines = lines.withColumn("same", same).withColumn("size", F.least(F.lit(WINDOW), F.size("part")))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - F.col("size") + 1), lambda k: F.aggregate(F.slice("same", k, F.col("size")), F.lit(0), lambda n, x: n + x)))
    lines = lines.withColumn("matched", best / F.col("size"))
    lines = lines.where((F.col("matched") >= LEAST_SHARE) & (F.col("size") >= F.least(F.lit(LEAST_WINDOW), F.size("item"))))
    return lines.groupBy("doc_id", "text_hash", "item_id").agg(F.max("matched").alias("matched"), F.sum(_hits(F.col("same"))).alias("hits"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contaminated documents, with the benchmark items found as text."""
    found = overlaps(docs, benchmark).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("matched").alias("matched"), F.sum("hits").alias("hits"))
    return found.select("doc_id", F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))).alias("items"), F.round("matched", 6).alias("matched"), "hits")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; same columns."""
    own = fresh(docs, "__own")
    bad = overlaps(docs, benchmark).select(F.col("doc_id").alias(f"{own}id"), F.col("text_hash").alias(f"{own}hash")).distinct()
    held = docs.withColumn(own, F.xxhash64("text"))
    return held.join(bad, held["doc_id"].eqNullSafe(bad[f"{own}id"]) & (held[own] == bad[f"{own}hash"]), "left_anti").select(*columns(docs))
