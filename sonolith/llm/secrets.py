"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

A document is a repository of its owner (`source` in the `documents` table).
Every candidate's value is hashed; the hash is counted over distinct owners and
distinct repositories of the whole corpus. A value that many of the corpus's owners
hold is a copied example, however many repositories of few owners hold it; one that
few hold and that looks random is live.

Defined results: null text counts as empty; null owners are one owner of their
own; repeated rows give repeated results (and count once as a repository when
all their columns agree); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.llm.common import columns, fresh, join_one, stable, whole

#: The base patterns, in their listed order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Formats of public providers, and private key headers.
PROVIDER = r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
#: Bare values that count only when ownership shows them as live.
OPAQUE = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "provider", "opaque")
BASE = 3

SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


#: Spans that one fold gathers; longer arrays are folded by blocks, so that their cost stays in proportion.
FOLD = 256


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body and its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _folds(items: Column) -> Column:
    """The items in blocks of FOLD."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / FOLD).cast("int")), lambda k: F.slice(items, k * FOLD + 1, FOLD))


def _running(values: Column, add) -> Column:
    """For each block's value, what add makes of 0 and all values before."""
    start = F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, lambda acc, v: F.struct(add(acc["now"], v).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")))["out"]


def _matches(text: Column, pattern: str, rank: int, group: int = 0) -> Column:
    """Spans of all non-overlapping matches, leftmost first, in code points.

    The pieces between matches and the matches themselves alternate, so running
    lengths give the positions.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
    pairs = F.filter(F.zip_with(pieces, found, lambda piece, m: F.struct(F.length(piece).alias("gap"), F.length(m).alias("length"), m.alias("found"))), lambda x: x["found"].isNotNull())

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + x["length"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), value(x["found"]).alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def placed(block, at):
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step)["out"]

    def by_blocks(blocks):
        lengths = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["length"]))
        return F.flatten(F.zip_with(blocks, _running(lengths, lambda now, n: now + n), placed))

    return F.when(text.rlike(pattern), _let(pairs, lambda all_: _let(_folds(all_), by_blocks))).otherwise(F.array().cast(SPAN))


def _meets(spans: Column, other: Column) -> Column:
    """Whether a span overlaps one of spans, which are in order and apart: a binary search."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))

    def halve(acc, _):
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        before = F.get(spans, middle)["start"] < other["end"]
        open_ = acc["low"] < acc["high"]
        return F.struct(F.when(open_ & before, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~before, middle).otherwise(acc["high"]).alias("high"))

    count = F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), halve)["low"]
    return F.coalesce(F.get(spans, count - 1)["end"] > other["start"], F.lit(False))


def candidates(text: Column) -> Column:
    """All candidate spans of a text, sorted by start, then kind. Their cost grows with
    the text and, but for a sort, with the number of matches."""
    assign = _matches(text, ASSIGN, 0, 2)
    opaque = F.filter(_matches(text, OPAQUE, 4), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    named = F.array(F.filter(assign, lambda s: F.length(s["value"]) >= 6), _matches(text, ACCESS, 1), _matches(text, HEX, 2), _matches(text, PROVIDER, 3))
    all_ = F.struct(named.alias("named"), opaque.alias("opaque"))

    def apart(x):
        free = F.filter(x["opaque"], lambda o: ~F.exists(x["named"], lambda kind: (F.size(kind) > 0) & _meets(kind, o)))
        return F.array_sort(F.concat(F.flatten(x["named"]), free))

    return _let(all_, apart)


def ownership(found: DataFrame) -> DataFrame:
    """value hash -> distinct owners and repositories. found: hash, owner, repo.

    Duplicates go before the first shuffle and again by all three columns, so a
    hash that a third of the rows hold is spread over its repositories.
    """
    by_owner = found.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def scan(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source", copied_owners: int = 3, min_symbols: int = 6, copied_share: float = 0.1) -> DataFrame:
    """docs with `secrets`: array of (start, kind, end, status, n_owners, n_repos),
    for one row of output per row of input. status is copied (at least
    copied_owners owners and copied_share of all owners), placeholder (fewer than
    min_symbols distinct characters) or live.
    Columns of docs other than the three named are not carried.
    """
    rows = docs.select(F.col(repo).alias("repo"), F.col(owner).alias("owner"), candidates(whole(text)).alias("found"))
    rows = rows.withColumn("found", F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.sha2(s["value"].cast("binary"), 256).alias("hash"), F.size(F.array_distinct(F.split(s["value"], ""))).alias("symbols"))))
    rows = rows.withColumn("key", F.when(F.size("found") > 0, F.sha2(F.to_json(F.struct("repo", "owner", "found")), 256)))
    rows = stable(rows, "secrets")
    each = rows.where("key is not null").dropDuplicates(["key"]).select("key", "repo", "owner", F.explode("found").alias("s")).select("key", "repo", "owner", "s.*")
    each = stable(each, "secrets-each")
    held = each.groupBy("hash").agg(F.count(F.lit(1)).alias("n_held"))
    owned = stable(ownership(each).join(held, "hash"), "secrets-owned")
    least = max(copied_owners, ceil(copied_share * rows.select("owner").distinct().count()))
    status = F.when(F.col("n_owners") >= least, "copied").when(F.col("symbols") < min_symbols, "placeholder").otherwise("live")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    judged = join_one(each, owned, "hash", "n_held", each.count()).withColumn("status", status).where((F.col("rank") < 4) | (F.col("status") == "live"))
    by_key = judged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", kind.alias("kind"), "status", "n_owners", "n_repos"))).alias("secrets"))
    # Rows without candidates have no key and take no part in the join.
    full = rows.where("key is not null").select("repo", "owner", "key").join(by_key, "key", "left").select("repo", "owner", "secrets")
    empty = rows.where("key is null").select("repo", "owner", F.lit(None).cast(full.schema["secrets"].dataType).alias("secrets"))
    return full.unionByName(empty).select(F.col("repo").alias(repo), F.col("owner").alias(owner), F.coalesce("secrets", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,status:string,n_owners:bigint,n_repos:bigint>>")).alias("secrets"))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _of_kind(rank: int):
    """A test of one parameter: `F.filter` hands an element's index to a second one."""
    return lambda s: s["rank"] == rank


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of `scan` for each document."""
    count = lambda test: F.size(F.filter("secrets", test)).cast("long")
    base = F.filter("secrets", lambda s: s["rank"] < BASE)
    return scan(docs).select(
        "doc_id",
        *[count(_of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        count(lambda s: s["status"] == "live").alias("n_live"),
        count(lambda s: s["status"] == "copied").alias("n_copied"),
    )


def redact(docs: DataFrame, mask: str = "[REDACTED]") -> DataFrame:
    """docs with live and placeholder-free spans replaced by the mask; same columns.
    Copied examples stay. Overlapping spans are masked once."""
    key = F.sha2(F.to_json(F.struct("doc_id", "source", F.sha2(whole("text").cast("binary"), 256).alias("h"))), 256)
    own, spans = fresh(docs, "__key"), fresh(docs, "__spans")
    held = docs.withColumn(own, key)
    marked = scan(held.select(F.col(own).alias("doc_id"), "source", "text")).where(F.exists("secrets", lambda s: s["status"] == "live"))
    marked = marked.select(F.col("doc_id").alias(own), F.filter("secrets", lambda s: s["status"] == "live").alias(spans)).dropDuplicates([own])
    text, all_ = whole("text"), F.col(spans)

    def masked(block, at):
        """What stands from `at`, the end of all blocks before, to the end of this one."""
        part = F.substring(text, at + 1, F.array_max(F.transform(block, lambda s: s["end"])) - at)

        def fold(part):
            def step(acc, s):
                gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(part, acc["at"] - at + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise("")
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

            return F.aggregate(block, F.struct(at.alias("at"), F.lit("").alias("out")), step)["out"]

        return _let(part, fold)

    def by_blocks(blocks):
        ends = F.transform(blocks, lambda block: F.array_max(F.transform(block, lambda s: s["end"])))
        return F.array_join(F.zip_with(blocks, _running(ends, F.greatest), masked), "")

    rest = F.substring(text, F.array_max(F.transform(all_, lambda s: s["end"])) + 1, F.length(text))
    folded = F.concat(_let(_folds(all_), by_blocks), rest)
    out = held.join(marked, own, "left").withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(folded))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*columns(docs))
