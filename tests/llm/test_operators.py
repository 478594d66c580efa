"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonolith.llm import chat, decontaminate, html, jaccard, language, licenses, markov, mixing, queries, secrets

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu na pe ri so tu".split() for b in "l n r s t".split()]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


# Secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_match_brute_force(spark):
    rng = random.Random(3)
    parts = ["token=token:abcdefghi", "password = 'abc'", 'API_KEY: "q1w2e3r4"', "AKIA" + "A1" * 8, "AKIAshort", "0123456789abcdef" * 2, "dead beef", "é漢\U0001f600", "secret==abcdefgh", "passwd:x.y/z+w=", " ", "\n", "word"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    got = {r["doc_id"]: r for r in secrets.report(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(base_spans(t).encode()).hexdigest(), t
        kinds = Counter(x.partition(":")[0] for x in base_spans(t).split(","))
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [kinds[k] for k in ("assign", "access", "hex")], t


def test_ownership(spark):
    value = "password=Qw3rTy9LkJh2"
    rows = [(i, f"here {value} x", "en", f"s{i}", 1) for i in range(5)] + [(9, "password=Zx8cVb1nMq0P", "en", "s1", 1), (10, "token=aaaaaaaa", "en", "s1", 1), (11, "bare k3J9xPq27LmZw81RtYv5 end", "en", "s2", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in secrets.report(df).collect()}
    assert got[0]["n_copied"] == 1 and got[0]["n_live"] == 0 and got[9]["n_live"] == 1 and got[10]["n_live"] == 0
    assert got[11]["spans"] == "opaque:5:25" and got[11]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[9] == "[REDACTED]" and clean[0] == rows[0][1] and clean[11] == "bare [REDACTED] end"


def test_one_owner_is_no_breadth(spark):
    """A credential of one owner, or of few of many owners, is live in however many documents it stands."""
    hot, few, wide = "password=Qw3rTy9LkJh2", "k3J9xPq27LmZw81RtYv5", "token=Hx4vNq8RzKd7"
    rows = [(i, f"note {i} {hot} end", "en", "s0", 1) for i in range(30)]
    rows += [(100 + i, f"note {i} {few} end", "en", f"s{i}", 1) for i in range(4)]
    rows += [(200 + i, f"note {i} {wide if i < 20 else 'none'} end", "en", f"s{i}", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in secrets.report(df).collect()}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    for i, text, *_ in rows:
        live, copied = hot in text or few in text, wide in text
        assert (got[i]["n_live"], got[i]["n_copied"]) == (int(live), int(copied))
        assert clean[i] == text.replace(hot, "[REDACTED]").replace(few, "[REDACTED]")
    assert got[100]["spans"] == "opaque:7:27"


# Languages


def test_language_accuracy(spark):
    rng = random.Random(5)
    syllables = {"aa": "tor vek lun".split(), "bb": "sha mio pel".split(), "cc": "gru dax wyn".split()}
    rows = [(i, " ".join("".join(rng.choices(s, k=rng.randint(1, 3))) for _ in range(12)), lang, "s", 1) for i, (lang, s) in enumerate(itertools.islice(itertools.cycle(syllables.items()), 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in language.report(df).collect()}
    assert all(got[r[0]]["held_out"] == (crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert len(held) > 40 and sum(got[r[0]]["lang_pred"] == r[2] for r in held) / len(held) > 0.97


def test_bloom_has_no_false_negatives(spark):
    df = docs_of(spark, [prose(random.Random(i), 30) for i in range(40)])
    model = language.train(df, least_count=1)
    for r in df.collect():
        assert model.scores(language.grams(language.letters(r["text"])))[0] > 0.99


# Mixing


def filled(sizes, weights, most=3):
    left, capped = dict(weights), {}
    total = sum(sizes.values())
    while left:
        level = (total - sum(capped.values())) / sum(left.values())
        over = [s for s in left if left[s] * level > most * sizes[s] + 1e-9]
        if not over:
            break
        for s in over:
            capped[s] = most * sizes[s]
            del left[s]
    return capped | {s: left[s] * level for s in left}


def test_mixing_targets_and_totals(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(1, 60)), "en", s, 1) for i, s in enumerate(rng.choices(["a", "b", "c", "é", None], [70, 20, 5, 2, 3], k=1500))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(df, bucket=40).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    names = sorted([s for s in sizes if s is not None]) + [None]
    want = filled(sizes, {s: 1 + k % 3 for k, s in enumerate(names)})
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    taken, expected_docs, docs = Counter(), Counter(), Counter()
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
        docs[r["source"]] += r["copies"]
        expected_docs[r["source"]] += want[r["source"]] / sizes[r["source"]]
    for s in names:
        assert abs(taken[s] - want[s]) <= 60 and abs(docs[s] - expected_docs[s]) <= 2.01
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(7), bucket=40).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(1, 50)), min_size=1, max_size=60))
def test_flight_keeps_both_totals(units):
    p, size = np.array([u[0] for u in units]), np.array([u[1] for u in units], float)
    out = mixing.fly(p, size, np.random.default_rng(0))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-6) and out @ size == pytest.approx(p @ size, abs=1e-4)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(0.05, 0.95), st.integers(1, 50)), min_size=30, max_size=60), st.lists(st.integers(300, 400), max_size=2), st.integers(0, 9))
def test_long_documents_are_made_up_for(units, long, seed):
    units = sorted(units + [(0.4, n) for n in long], key=lambda u: -u[1])
    p, size = np.array([u[0] for u in units]), np.array([u[1] for u in units], float)
    out = mixing.settle_heavy(p, size, np.random.default_rng(seed))
    assert out @ size == pytest.approx(p @ size, abs=1e-6) and ((out >= 0) & (out <= 1)).all()
    steps = mixing.ladder(size)
    assert len(steps) <= mixing.LADDER and (size[steps][1:] <= size[steps][:-1] / 2).all()


def test_mix_is_near_the_target_despite_one_long_document(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(1, 90) if i > 2 else 2500), f"s{i % 3}") for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {r["source"]: r["target"] for r in got}
    for r in got:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 30 for s in target), (taken, target)


# Decontamination


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(11)
    items = [prose(rng, n) for n in (14, 25, 40, 60, 8, 3)]
    texts = [prose(rng, 80) for _ in range(40)]
    planted = {}
    for k in range(60):
        item = k % 4
        words = items[item].split()
        for at in rng.sample(range(len(words)), len(words) // 10):
            words[at] = rng.choice(WORDS)
        begin = prose(rng, rng.randint(0, 30))
        planted[len(texts)] = item
        texts.append(" ".join([begin, " ".join(words).upper() + ",", prose(rng, rng.randint(0, 30))]))
    texts += [items[4], "x " + items[5] + " y"]
    planted |= {len(texts) - 2: 4, len(texts) - 1: 5}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.report(docs_of(spark, texts), bench).collect()}
    assert sum(got.get(d) == str(i) for d, i in planted.items()) >= len(planted) - 1
    assert not set(got) - set(planted)


# Hidden Markov model


def naive(model, ids):
    alpha, total = model.start * model.emit[ids[0]], 0.0
    for k in range(len(ids)):
        if k:
            alpha = (alpha @ model.move) * model.emit[ids[k]]
        total += math.log(alpha.sum())
        alpha = alpha / alpha.sum()
    return total


def test_forward_and_expected_counts(spark):
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (0, 1, 5, 63, 64, 65, 128, 300)] * 3
    model, _ = markov.fit(docs_of(spark, texts))
    ids = [model.symbols(markov.words(t))[0] for t in texts]
    got = markov.forward(model, markov.Blocks(ids))[0]
    assert got == pytest.approx([naive(model, x) for x in ids])
    # Expected counts are derivatives of the log likelihood by the log parameters.
    sums = markov.expected(model, markov.Blocks(ids))
    assert sums[: markov.STATES].sum() == pytest.approx(len(ids))
    assert sums[markov.STATES + markov.STATES**2 :].sum() == pytest.approx(sum(map(len, ids)))
    before = sum(naive(model, x) for x in ids)
    h, kept = 1e-6, model.move.copy()
    model.move[0, 1] *= 1 + h
    slope = (sum(naive(model, x) for x in ids) - before) / h
    model.move = kept
    assert sums[markov.STATES + 1] == pytest.approx(slope, rel=1e-3, abs=1e-3)


def test_training_raises_likelihood_and_base_is_exact(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(WORDS[:20] if i % 2 else WORDS[40:], k=rng.randint(5, 40))) for i in range(200)]
    df = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in markov.report(df).collect()}
    train = [t for i, t in enumerate(texts) if crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in t.split())
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    for i, t in enumerate(texts):
        want = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t.split()) + math.log10((len(train) + 0.5) / (n + 0.5 * (v + 1)))
        assert got[i]["base_score"] == pytest.approx(want) and got[i]["train_tokens"] == n
        assert got[i]["n_known"] == sum(w in counts for w in t.split()) + 1
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


# Licences


def test_license_places_match_brute_force(spark):
    rng = random.Random(8)
    parts = ["gnu general public license", "GNU General-Public  License", "apache license", "cc by", "mit license", "mit license mit license", "license", "gnu general", "é", "zz"]
    texts = [rng.choice([" ", ", ", "\n"]).join(rng.choices(parts, k=rng.randint(0, 8))) for _ in range(200)]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(at)), t
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None)), t
        assert r["base_labels"] == ",".join(sorted({x[1] for x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_license_templates_by_position(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy"
    shuffled = " ".join(sorted(mit.split()))
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, [mit, shuffled, "This work is licensed under the GNU General Public License, version 3.", "plain"])).collect()}
    assert [got[k]["labels"] for k in range(4)] == ["mit", "", "gpl,gpl-3.0", ""]
    assert got[0]["score"] > 0.9 and got[3]["score"] == 0


def test_two_notices_in_one_file(spark, tmp_path):
    pairs = list(itertools.combinations(licenses.TEMPLATES, 2))
    texts = [f"{a[1]}\n\nriver stone lamp\n\n{b[1]}" for a, b in pairs] + ["river stone lamp"] * 1000
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in queries.queries()["op7_license_scan"](spark, str(tmp_path)).collect()}
    assert [(a[0], b[0]) for k, (a, b) in enumerate(pairs) if not {a[0], b[0]} <= got[k]] == []


def test_license_templates_as_a_table(spark):
    """Whole licence texts, with the rest of a file around them, words put in, and near misses."""
    rng = random.Random(21)
    words = [f"{a}{b}" for a in ("grant", "warrant", "liab", "copy", "notic", "sublic") for b in ("s", "ed", "ing", "able", "ion", "or", "ant")] + ["the", "of", "and", "to"] * 6
    made = {f"lic-{k}": rng.choices(words, k=900) for k in range(4)}
    phrases = {n: " ".join(w[400:404]) for n, w in made.items()} | {"lic-3": None}
    table = spark.createDataFrame([(n, " ".join(w).upper(), phrases[n]) for n, w in made.items()] * 2 + [(None, "grants", "grants"), ("empty", "", None)], "label string, notice string, phrase string")
    prose = lambda k: " ".join(rng.choices(["river", "stone", "lamp", "the", "of"], k=k))
    inside = {n: [*w[:300], "years", "holder", "name", *w[300:]] for n, w in made.items()}
    texts = [f"{prose(37)}\n{' '.join(made['lic-0'])}\n{prose(5)}\n{' '.join(made['lic-3'])}"]
    texts += [" ".join(inside["lic-1"]), " ".join([*made["lic-2"][:400], "x", *made["lic-2"][404:]]), " ".join(sorted(made["lic-3"])), *(prose(50) for _ in range(300)), None, ""]
    docs = docs_of(spark, texts)
    got = {k: {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs, templates=table, drift=k).collect()} for k in (0, 3)}
    assert got[0][0] == ("lic-0,lic-3", 1.0) and got[3][0] == ("lic-0,lic-3", 1.0)
    assert got[3][1] == ("lic-1", 1.0) and got[0][1][1] < 1
    assert [got[k][i][0] for k in (0, 3) for i in (2, 3, 4, 304, 305)] == [""] * 10
    assert len(got[0]) == len(texts)
    none = licenses.scan(docs, templates=table.where("false")).where("labels != ''")
    assert none.count() == 0


# Pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a>Home</a></li></ul></nav><div class="ad">Buy, now. Really, do.</div>%s
<form><p>Search, here.</p></form><footer>&copy; x</footer></body>"""


def test_html_article():
    body = "<article><h1>A &amp; B</h1><p><b>One,\n two.<br><p>Three &eacute;; four.</p><ul><li>Item, one.</ul><!-- no --><section class='comments'><p>Nice, post.</p></section></article>"
    assert html.extract(PAGE % body) == "A & B\nOne, two.\nThree é; four.\nItem, one."


LONG = "The river rose for three days, and the people moved their animals to higher ground. "


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><p>{LONG}</p><ul><li>Bread</li></ul><blockquote>Short quote</blockquote></article>", [LONG.strip(), "Bread", "Short quote"]),
        (f"<div class='post-header'><h1>Title</h1></div><div class='post-body'><p>{LONG}</p></div>", ["Title", LONG.strip()]),
        (f"<div class='has-sidebar comments-open'><article><p>{LONG}</p></article></div>", [LONG.strip()]),
        (f"<div class='page-sidebar'><p>{LONG}</p></div><article><p>Text.</p><div id='comments'><article><p>{LONG}</p></article></div></article>", ["Text."]),
        (f"<table><tr><td><a>Menu</a> <a>More</a></td><td>{LONG}</td></tr></table>", [LONG.strip()]),
    ],
)
def test_html_regions(page, want):
    assert html.extract(page).split("\n") == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>Own, text. Here it is.</p></article><article class='comment'><p>Nice post, thanks.</p></article>", "Own, text. Here it is."),
        (f"<main><article><p>{LONG}</p><article id='comment-12'><p>{LONG}</p></article></article></main>", LONG.strip()),
        (f"<article class='post comments-open widget'><p>{LONG}</p></article>", LONG.strip()),
        (f"<article><div class='header'><h1>Title of it</h1></div><p>{LONG}</p></article>", f"Title of it\n{LONG.strip()}"),
        ("<article><p>Let <math><mi>x</mi></math> be, well</p><p>A <object>fallback</object> stays.</p></article>", "Let x be, well\nA fallback stays."),
        ("<article><p>A <button>Click</button> b, <span class='ad'>Buy</span>c.<script>x</script> D.</p></article>", "A b, c. D."),
    ],
)
def test_html_articles_of_others_headers_and_inline_parts(page, want):
    assert html.extract(page) == want


def test_html_without_markup_of_the_article():
    body = "<div id='c'>" + "".join(f"<p>Sentence {k}, with some words; and more, of it. Then the end.</p>" for k in range(5)) + "</div><div><span>Tag</span></div><ul><li>x</li><li>y</li></ul>"
    got = html.extract(PAGE % body).split("\n")
    assert len(got) == 5 and all(x.startswith("Sentence") for x in got)


# Chats

control = st.lists(st.sampled_from([*"<|>\\abn\n é", "im_start", "im_end"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "a\nb\\"]), control), min_size=1, max_size=12), st.integers(8, 60))
def test_windows_round_trip(turns, budget):
    maker = chat.Windower(budget, budget // 2)
    made = [w for r, t in turns for w in maker.add(7, r, t)] + list(maker.finish())
    back, said = [], ""
    for _, _, text, fresh, targets in made:
        back += [(r, t) for begin, _, r, t in chat.parse(text) if begin >= fresh]
        said += "".join(chat.unescape(text[a:b]) for a, b in zip(targets[::2], targets[1::2], strict=True))
    assert back == turns
    assert said == "".join(t for r, t in turns if r == "assistant")
    if turns[0][0] == "system":
        assert all(w[2].startswith(made[0][2][: len(chat.START) + 6]) for w in made)


# Jaccard join


def test_join_matches_brute_force(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(60):
        words = prose(rng, rng.randint(30, 120)).split()
        for _ in range(rng.choice([1, 1, 2, 6, 20])):
            copy = list(words)
            for at in rng.sample(range(len(copy)), rng.randint(0, 3)):
                copy[at] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    texts += [texts[0]] * 5
    common = prose(rng, 40)
    texts += [common + " " + prose(rng, 2) for _ in range(150)]  # a large bucket
    got = {r["doc_id"]: r for r in jaccard.report(docs_of(spark, texts)).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    links, parent = Counter(), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            links[a] += 1
            links[b] += 1
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    found = sum(got[k]["n_links"] for k in range(len(texts)))
    assert found <= sum(links.values()) and found >= 0.999 * sum(links.values())
    assert sum(got[k]["class_id"] == find(k) for k in range(len(texts))) >= len(texts) - 2


def test_blocks_count_each_link_once():
    rng = np.random.default_rng(0)
    core = np.arange(50, dtype=np.uint32)
    sets = [np.union1d(core, rng.integers(100, 10_000, 3).astype(np.uint32)) for _ in range(30)]
    keys, weights = [bytes([k]) for k in range(30)], np.arange(1, 31)
    leaves = [np.array([5, 9]) if k < 20 else np.array([9]) for k in range(30)]
    own = np.arange(30) % 2
    total = Counter()
    for leaf, members in ((5, range(20)), (9, range(30))):
        for sides in ((0, 0), (0, 1), (1, 1)):
            part = [k for k in members if own[k] in sides]
            side = None if sides[0] == sides[1] else own[part]
            for key, _, n in jaccard.brute_force(leaf, [keys[k] for k in part], weights[part], [sets[k] for k in part], [leaves[k] for k in part], side):
                total[key] += n
    assert all(total[keys[k]] == weights.sum() - weights[k] for k in range(30))


def test_every_training_text_shapes_the_language_model(spark):
    """Baum-Welch began on some 400 of the 785 training texts: -3.94 a held-out token, as against -3.82."""
    from pyspark.sql import functions as F

    got = markov.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    assert got.agg(F.sum("score") / F.sum("n_tokens")).first()[0] > -3.88


def test_word_counts_alone_give_the_base_columns(spark, monkeypatch):
    """lm_base learnt the states, which none of its columns shows."""
    folder = "/root/testdata/sf0.001"
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    full = {tuple(r)[:5]: r["base_score"] for r in markov.report(spark.read.parquet(f"{folder}/documents.parquet")).select(*names, "base_score").collect()}

    def learnt(*args, **kwargs):
        raise AssertionError("states are learnt")

    monkeypatch.setattr(markov, "fit", learnt)
    got = {tuple(r)[:5]: r["base_score"] for r in queries.queries()["lm_base"](spark, folder).collect()}
    assert got.keys() == full.keys()
    assert all(got[k] == pytest.approx(full[k], abs=6e-4) for k in full)
