"""Phrases, conversation tries and near vectors against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sonolith.llm import neardup, phrases, trie

CONVERSATION = "conv_id long, turn long, role string, text string"


def brute_phrases(rows, least, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    inside = {(lang, w[i : i + k]) for (lang, w), a in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * a >= 100 * found[lang, w[i : i + k]]}
    out = defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    return sorted((lang, r, x[2].decode(), *x[3:]) for lang, all_ in out.items() for r, x in enumerate(sorted(all_)[:top], 1))


@pytest.fixture(scope="module")
def said():
    rng = random.Random(3)
    words = "The river; ran\tran past past, the old MILL\n mill é Ünï 漢 a\x1cb x. y".split(" ")
    texts = [" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 120))) for _ in range(150)]
    return [(rng.choice(["en", "de", None]), t) for t in [*texts, None, "", "ran " * 3000, "   "]]


@pytest.mark.parametrize("split", [1 << 16, 2])
def test_phrases(spark, said, split):
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(said)], "doc_id long, text string, lang string")
    got = sorted(map(tuple, phrases.collocations(docs, least=12, split=split).collect()))
    assert got == brute_phrases(said, 12) and len(got) > 30
    assert [r for r in got if r[1] <= 3] == sorted(map(tuple, phrases.collocations(docs, least=12, top=3).collect()))


def test_phrase_scores_are_exact_beyond_64_bits(spark):
    q = "(cast(1000 * a as decimal(18,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    rows = [(10**14 + 7, 10**17 + 1, 10**15 + 9, 10**14 + 11), (3, 10**17 + 3, 7, 11), (10**12 - 1, 10**13 - 1, 10**12 + 1, 10**12 + 3)]
    for r in spark.createDataFrame(rows, "a long, n long, l long, r long").selectExpr("*", f"{q} AS s").collect():
        assert r["s"] == 1000 * r["a"] * r["n"] // (r["l"] * r["r"])


def test_tokens_in_stretches():
    text = "Ab, c\td.e\nf  é" * 50
    whole = [t for part in phrases.tokens(text.encode()) for t in part]
    assert whole == [t for part in phrases.tokens(text.encode(), 7) for t in part]
    assert sum(t != b"\n" for t in whole) == sum(len(re.findall("[^ \t]+", p)) for p in re.split("[.,;:!?\n]", text))


def test_phrases_of_streams_in_parts(monkeypatch):
    monkeypatch.setattr(phrases, "STREAM", 10)
    pd = phrases.pd
    batch = pd.DataFrame({"lang": ["en"] * 3, "text": [b"a b c d e f g h i j k l m", b"", b"a b c d " * 9]})
    monkeypatch.setattr(phrases, "STRETCH", 5)
    ids = phrases._Ids("en", np.full(phrases.BITMAP // 8, 255, np.uint8))
    want = Counter()
    for text in batch["text"]:
        w = [ids[x] for x in text.split()] + [0] * 4
        want.update(tuple(w[i : i + 2]) for i in range(len(w) - 4))
    got = Counter()
    for stream in phrases._streams(iter([batch]), ids.bits):
        got.update((int(a), int(b)) for a, b in zip(stream[:-4], stream[1:-3], strict=True) if a)
    assert got == want


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in own.items():
        if c is not None:
            h = zlib.crc32(str(c).encode()) % 9
            v = own.get(c - abs(c) % 5 * (1 if c >= 0 else -1), [])[:h] + v[h:]
            ends[tuple(v)].append(c)
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    least = lambda p: min((x for x in members[p] if x is not None), default=None)
    hash_of = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return Counter((least(p), len(p), least(p[:-1]) if p else None, len(m), kids[p], leaves[p], saved[p], hash_of(p)) for p, m in members.items())


@pytest.mark.parametrize("limits", [{}, {"range_bytes": 500, "run_paths": 7}])
def test_trie(spark, limits):
    rng = random.Random(3)
    rows = [(c, rng.choice([None, *range(4)]), rng.choice(["u", "a", None]), rng.choice(["x", "é", None])) for c in [*range(-30, 300), None] for _ in range(rng.randint(1, 6))]
    rows += [(1000, i, "u", str(i)) for i in range(120)] + [(1005, i, "u", str(i)) for i in range(110)] + [(c, 0, "u", "hot") for c in range(2000, 2400)]
    df = spark.createDataFrame(rows, CONVERSATION).repartition(5)
    assert Counter(map(tuple, trie.trie(df, **limits).collect())) == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless(spark):
    assert trie.report(spark.createDataFrame([], CONVERSATION)).count() == 0
    # 8 takes more turns from an absent head than it has of its own.
    h = zlib.crc32(b"8") % 9
    rows = [(8, i, "u", "x") for i in range(max(1, h))]
    assert Counter(map(tuple, trie.report(spark.createDataFrame(rows, CONVERSATION)).collect())) == brute_trie(rows)


def test_merge_of_runs():
    rng = random.Random(1)
    turns = [hashlib.md5(bytes([k])).digest() for k in range(3)]
    paths = list({b"".join(rng.choices(turns, k=rng.randint(0, 8))) for _ in range(400)})
    for k in (1, 2, 5, 13):
        runs = []
        for own in (sorted(paths[i::k]) for i in range(k)):
            runs.append(iter([trie.Row(p, trie.shared(q, p), [], 1, 0) for q, p in zip([b"", *own], own, strict=False)]))
        got = list(trie.merged(runs))
        assert [r.path for r in got] == sorted(paths)
        assert [r.lcp for r in got[1:]] == [trie.shared(x.path, y.path) for x, y in zip(got, got[1:], strict=False)]


def brute_near(x, level=0.9):
    u = neardup.unit(np.asarray(x))
    near = u @ u.T >= level
    np.fill_diagonal(near, False)
    return near.sum(1), neardup.least_reached(len(u), *np.nonzero(near))


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    away = rng.standard_normal((1500, 64))
    away -= (away * base).sum(1)[:, None] * base
    away /= np.linalg.norm(away, axis=1)[:, None]
    c = rng.uniform(0.88, 0.93, 1500)[:, None]
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * away, base[:7], 3 * base[:4]])
    links, component = brute_near(x)
    got = neardup.classes(vectors(spark, x)).orderBy("vec_id").toPandas()
    assert (got["n_links"] <= links).all()
    assert got["n_links"].sum() >= 0.97 * links.sum()
    assert (got["component_id"] == component).mean() >= 0.99
    assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()


@pytest.mark.parametrize("spread", [0.02, 0.05])
def test_dense_lists_in_blocks(spark, spread):
    """Blocks that link as a whole, that may, and that can't; sums equal brute force within one list."""
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(48)
    x = centre / np.linalg.norm(centre) + spread * rng.standard_normal((900, 48))
    links, component = brute_near(x)
    got = neardup.classes(vectors(spark, x), block=64).orderBy("vec_id").toPandas()
    assert (got["n_links"] <= links).all() and got["n_links"].sum() >= 0.95 * links.sum()
    assert (got["component_id"] == component).mean() >= 0.99
    whole = neardup.classes(vectors(spark, x), block=4096).orderBy("vec_id").toPandas()
    assert got.equals(whole)


def test_codes_estimate_without_bias():
    rng = np.random.default_rng(5)
    turn, c = neardup.rotation(64), np.zeros(64)
    x, q = neardup.unit(rng.standard_normal((400, 64))), neardup.unit(rng.standard_normal((400, 64)))
    code, norm, fix = neardup.encode(x - c, turn)
    signs = np.unpackbits(code, axis=1, count=64).astype(float) * 2 - 1
    error = signs @ (q @ turn).T / (8 * fix[:, None]) - x @ q.T
    bound = np.sqrt(1 - fix * fix) / fix / np.sqrt(63)
    assert abs(error.mean()) < 0.002 and (np.abs(error) > neardup.SURE * bound[:, None]).mean() < 1e-4


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0, 0.0]), (None, [1.0, 1.0]), (10, [1e200, 1e200]), (11, [-1.0, -1.0]), (None, None)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, key string, weight int")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in neardup.report(df).collect())
    alone = [(str(k), 0, k, True) for k in (1, 2, 3, 4, 5, 6, 9, 11)]
    assert got == sorted([*alone, ("7", 4, 7, True), ("7", 4, 7, True), ("8", 4, 7, False), ("10", 4, 7, False), ("None", 4, 7, False), ("None", 0, None, True)])
    assert neardup.report(df.limit(0)).count() == 0


def test_odd_documents(spark, odd, empty):
    assert phrases.report(empty).count() == 0
    got = {(r["lang"], r["phrase"]) for r in phrases.report(odd).collect()}
    assert ("de", "the quick brown fox jumps") in got and all(lang == "de" for lang, _ in got)
