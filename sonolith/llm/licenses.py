"""Licence scans with a positional rare-token index (DataFrame functions only).

Each file's licence words weigh by their inverse document frequency over the whole
corpus; their postings (template, position) are intersected by relative position,
and a template is reported only where its key phrase stands.

Defined results: null or empty text has no words and no label; repeated rows give
repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.llm.common import stable, whole

#: Base phrases and labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label, notice, key phrase that must stand in the file.
TEMPLATES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
#: Too common in any prose to be looked up.
COMMON = frozenset("a and any are by for forms free in is of or person source the this to use with without work copy 0 1 2 3 4 v".split())
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: A larger table of templates raises: its words stand in the plan, and its index is broadcast.
TEMPLATE_BYTES = 32 << 20


def _words(text: str | Column) -> Column:
    """The words of a text, a blank between them."""
    return F.trim(F.regexp_replace(F.translate(whole(text), CAPITALS, CAPITALS.lower()), WORD_GAP, " "))


def _templates(given: DataFrame | None) -> list[tuple[str, str, str]]:
    """Label, words and key phrase of the templates. Rows without label or words are none;
    rows alike count once."""
    if given is None:
        return list(TEMPLATES)
    held = given.select("label", _words("notice").alias("notice"), _words("phrase").alias("phrase")).where("label is not null and notice != ''").distinct()
    size = given.agg(F.sum(F.octet_length(whole("notice")) + F.octet_length(whole("phrase")))).first()[0]
    if (size or 0) > TEMPLATE_BYTES:
        raise ValueError(f"templates of {size} bytes; the index holds {TEMPLATE_BYTES}")
    return sorted(tuple(r) for r in held.collect())


def _vocabulary(templates) -> list[str]:
    return sorted({w for _, notice, _ in templates for w in notice.split()} - COMMON)


def _index(templates, idf: dict[str, float], index_words: int) -> list[tuple[str, int, int]]:
    """Postings (word, template, place) of each template's rarest words: those of the
    highest IDF for each time that the template has them."""
    out = []
    for t, (_, notice, _) in enumerate(templates):
        places: dict[str, list[int]] = {}
        for p, w in enumerate(notice.split()):
            if w not in COMMON:
                places.setdefault(w, []).append(p)
        rare = sorted(places, key=lambda w: (-idf[w] / len(places[w]), w))[:index_words]
        out += [(w, t, p) for w in rare for p in places[w]]
    return out


def _phrase_stats(s: Column, phrase: str, n_words: Column) -> tuple[Column, Column, Column]:
    """Places, first and last start of a phrase in ` w0 w1 ... wn `."""
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    at = F.locate(f" {phrase} ", s)
    apart = F.replace(s, F.lit(" "), F.lit("  "))
    mark = " " + phrase.replace(" ", "  ") + " "
    places = (F.length(apart) - F.length(F.replace(apart, F.lit(mark), F.lit("")))) / len(mark)
    tail = F.substring_index(s, f" {phrase} ", -1)
    words_after = F.when(F.trim(tail) == "", 0).otherwise(spaces(F.trim(tail)) + 1)
    has = at > 0
    return F.when(has, places.cast("long")).otherwise(0), F.when(has, (spaces(F.substring(s, F.lit(1), at)) - 1).cast("long")), F.when(has, (n_words - words_after - len(phrase.split())).cast("long"))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least_share: float = 0.6, templates: DataFrame | None = None, index_words: int = 64, drift: int = 0) -> DataFrame:
    """One row per row of docs: the kept columns, n_words, n_base, first_word,
    last_word, base_labels, labels (with the templates') and score, the share of
    the best verified template's IDF mass found at one relative position.

    templates: a table of label, notice (whole licence texts too) and phrase, which must
    stand in a file (null or empty: any file will do), in place of TEMPLATES. Each is
    indexed by its index_words rarest words. drift: places still count together when
    words put in or left out have moved them by so many words against each other."""
    templates = _templates(templates)
    vocabulary = _vocabulary(templates)
    rows = docs.select(*keep, _words(text).alias("__s"))
    rows = rows.withColumn("n_words", F.when(F.col("__s") == "", 0).otherwise(F.length("__s") - F.length(F.replace(F.col("__s"), F.lit(" "), F.lit(""))) + 1).cast("long"))
    rows = rows.withColumn("__s", F.concat(F.lit(" "), F.col("__s"), F.lit(" ")))
    stats = {p: _phrase_stats(F.col("__s"), p, F.col("n_words")) for p in PHRASES}
    words = F.split(F.trim("__s"), " ")
    hits = F.when(
        F.arrays_overlap(words, F.array(*map(F.lit, vocabulary)).cast("array<string>")),
        F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(vocabulary)),
    )
    keys = sorted({k for _, _, k in templates})
    stands = [F.when(F.col("__s").contains(f" {k} ") if k else F.lit(True), F.lit(k)) for k in keys]
    phrases = F.when(hits.isNotNull(), F.array_compact(F.array(*stands).cast("array<string>")))
    rows = rows.select(
        *keep, "n_words",
        sum((n for n, _, _ in stats.values()), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[a for _, a, _ in stats.values()]).alias("first_word"),
        F.greatest(*[b for _, _, b in stats.values()]).alias("last_word"),
        F.array_compact(F.array(*[F.when(stats[p][0] > 0, F.lit(label)) for p, label in PHRASES.items()])).alias("__base"),
        hits.alias("__hits"), phrases.alias("__phrases"), F.monotonically_increasing_id().alias("__row"),
    )
    rows = stable(rows, "licenses")
    each = rows.where("__hits is not null").select("__row", F.explode("__hits").alias("h")).select("__row", "h.word", "h.at")
    return _labelled(docs.sparkSession, rows, each, keep, least_share, templates, index_words, drift)


def _labelled(spark, rows: DataFrame, each: DataFrame, keep, least_share: float, templates, index_words: int, drift: int) -> DataFrame:
    total = rows.count()
    # The vocabulary of the templates bounds these counts.
    seen = {r["word"]: r["df"] for r in each.select("__row", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("df")).collect()}
    weight = {w: _idf(total, seen.get(w, 0)) for w in _vocabulary(templates)}
    idf = spark.createDataFrame(list(weight.items()), "word string, idf double")
    index = spark.createDataFrame(_index(templates, weight, index_words), "word string, template int, place int")
    mass = index.join(idf, "word").groupBy("template").agg(F.sum("idf").alias("mass"))
    held = F.broadcast(idf)
    at = each.join(held, "word")
    # A word has at most as many postings as places in the notices, so rows grow with the hits alone.
    at = at.join(F.broadcast(index), "word").withColumn("offset", F.col("at") - F.col("place"))
    if drift:
        # Offsets no more than drift apart share one of the overlapping lines; a place counts once in a line.
        line = F.floor(F.col("offset") / (drift + 1))
        at = at.withColumn("offset", F.explode(F.array(line, line - 1))).groupBy("__row", "template", "offset", "place").agg(F.max("idf").alias("idf"))
    aligned = at.groupBy("__row", "template", "offset").agg(F.sum("idf").alias("got")).groupBy("__row", "template").agg(F.max("got").alias("got"))
    names = spark.createDataFrame([(t, label, key) for t, (label, _, key) in enumerate(templates)], "template int, label string, phrase string")
    scored = aligned.join(F.broadcast(mass), "template").join(F.broadcast(names), "template").join(rows.where("__hits is not null").select("__row", "__phrases"), "__row")
    scored = scored.withColumn("share", F.least(F.lit(1.0), F.col("got") / F.col("mass"))).where(F.array_contains("__phrases", F.col("phrase")) & (F.col("share") >= least_share))
    found = scored.groupBy("__row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    text = lambda a: F.concat_ws(",", F.array_sort(F.array_distinct(a)))
    return rows.join(found, "__row", "left").select(
        *keep, "n_words", "n_base", "first_word", "last_word",
        text(F.col("__base")).alias("base_labels"),
        text(F.concat("__base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("__base") > 0, 1.0).otherwise(F.round(F.coalesce("share", F.lit(0.0)), 6)).alias("score"),
    )


def _idf(total: int, df: int) -> float:
    from math import log

    return log((total + 1) / (df + 1)) + 0.01
