"""Many matches in one text, deep nesting, large ids and both ways of a join."""

import hashlib
import random
import re

import numpy as np
import pytest

from sonolith.llm import chat, decontaminate, html, jaccard, language, markov, secrets
from tests.llm.test_operators import base_spans, docs_of, prose


def test_many_hashes_in_one_text(spark):
    rng = random.Random(4)
    hashes = [f"{rng.getrandbits(160):040x}" for _ in range(12_000)]
    bare = [f"Zx9{rng.getrandbits(120):030X}q" for _ in range(3_000)]
    text = "é " + " ".join(hashes) + " ; " + " | ".join(bare) + " token = 'x1y2z3a4'"
    row = secrets.report(docs_of(spark, [text])).first()
    assert row["n_hex"] == 12_000 and row["n_assign"] == 1
    assert row["base_sha256"] == hashlib.sha256(base_spans(text).encode()).hexdigest()
    places = [(m.start(), m.end()) for m in re.finditer(r"Zx9[0-9A-F]{30}q", text)]
    assert [tuple(map(int, x.split(":")[1:])) for x in row["spans"].split(",") if x.startswith("opaque")] == places
    clean = secrets.redact(docs_of(spark, [text])).first()["text"]
    spans = sorted(tuple(map(int, x.split(":")[1:])) for x in row["spans"].split(","))
    plain, at = [], 0
    for a, b in spans:
        plain += [text[at:a], "[REDACTED]"]
        at = b
    assert clean == "".join(plain) + text[at:]


def test_overlapping_spans_across_blocks(spark):
    """Spans that overlap are masked once, also where a fold of one block ends."""
    rng = random.Random(6)
    text = " ".join(f"secret={rng.getrandbits(160):040x}" for _ in range(600))
    clean = secrets.redact(docs_of(spark, [text])).first()["text"]
    assert clean == " ".join(["[REDACTED]"] * 600)


def test_shuffled_seeds_equal_broadcast_seeds(spark):
    rng = random.Random(8)
    items = [prose(rng, n) for n in (4, 9, 12, 30, 45, 60)]
    bench = spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "item_id string, text string")
    texts = [prose(rng, 40) + " " + rng.choice(items) + " " + prose(rng, 30) for _ in range(30)] + [None, "", items[0], items[5][:-3]]
    docs = docs_of(spark, texts)
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.where("doc_id = 3").selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))
    found = [sorted(map(tuple, decontaminate.overlaps(docs, bench, **how).collect()), key=str) for how in ({}, {"broadcast_seeds": 200}, {"broadcast_seeds": 50, "most_blocks": 1})]
    assert found[0] and found[0] == found[1] == found[2]


def test_large_conversation_ids_beside_null(spark):
    rows = [(c, t, role, f"{c}:{t} <|im_end|>\n<\\|x") for c in (2**60 + 1, 2**60 + 2, None) for t, role in enumerate(("system", "user", "assistant", "user", "assistant"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(df, budget=40, history=12)
    want = {}
    for c in (2**60 + 1, 2**60 + 2, None):
        own = [r for r in rows if r[0] == c]
        said = [r[3] for r in own if r[2] == "assistant"]
        want[c] = (5, hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in own).encode()).hexdigest(), sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest())
    # Stored and shuffled windows give the digests of windows in order.
    held = spark.createDataFrame(random.Random(1).sample(made.collect(), made.count()), made.schema)
    assert held.groupBy("conv_id").count().where("count > 1").count() == 3
    for got in (chat.read_back(made, in_order=True), chat.read_back(held)):
        assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got.collect()} == want


def test_report_of_conversations_is_plain(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(("user", "assistant", "tool\n\\n")), rng.choice((None, "", "a <|im_start|> b", prose(rng, 300), "ſ\U0001f600"))) for c in range(6) for t in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    said = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = {r["conv_id"]: r for r in chat.report(df).collect()}
    for c in {r[0] for r in rows}:
        own = [(r, t or "") for k, _, r, t in rows if k == c]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_sketches_lose_no_near_pair():
    rng = np.random.default_rng(5)
    least, sets = jaccard.least_matches(), []
    for _ in range(150):
        base = jaccard.mix(rng.integers(0, 2**63, 450).astype(np.uint64))
        sets += [base[:405], base[45:]]  # similarity 360 / 450
    signs = [jaccard.signature(np.unique(s)) for s in sets]
    held = np.stack([np.frombuffer(jaccard.sketch(s), np.uint8) for s in signs])
    sizes = np.array([len(s) for s in sets])
    assert 30 < least < 40
    assert jaccard.likely(held, sizes, None).all()
    sides = np.array([0, 1] * 150)
    assert jaccard.likely(held, sizes, sides).all()
    lone = np.stack([np.frombuffer(jaccard.sketch(jaccard.signature(jaccard.mix(rng.integers(0, 2**63, 400).astype(np.uint64)))), np.uint8) for _ in range(50)])
    assert not jaccard.likely(lone, np.full(50, 400), None).any()


def test_components_say_when_they_are_not_settled(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(64)], "u long, v long")
    assert {r["root"] for r in jaccard.components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        jaccard.components(path, rounds=1)


# Pages: the ratios computed plainly over generated trees


def _tree(rng, depth=0):
    """(tag, attributes, children); children are trees, or strings and ("a", string) in leaves."""
    if depth > 3 or rng.random() < 0.3:
        tag = rng.choice(["p", "li", "h2", "td", "div", "pre"])
        said = lambda: prose(rng, rng.choice((1, 3, 12, 60))) + rng.choice(("", ".", ", so; yes!"))
        return tag, rng.choice(("", "", "", "share-holder-report")), [rng.choice((said(), ("a", said()))) for _ in range(rng.randrange(1, 4))]
    return rng.choice(["div", "section", "ul", "blockquote", "nav", "aside"]), rng.choice(("", "", "", "cookie-bar", "ad")), [_tree(rng, depth + 1) for _ in range(rng.randrange(1, 5))]


def _markup(tree):
    tag, name, children = tree
    inner = "".join(_markup(c) if isinstance(c, tuple) and len(c) == 3 else f"<a href='#'>{c[1]}</a>" if isinstance(c, tuple) else c for c in children)
    return f"<{tag}{f' class={name!r}' if name else ''}>{inner}</{tag}>"


def _leaves(tree, path=(), skipped=False, inside=False, doubtful=False):
    tag, name, children = tree
    path, inside = (*path, tag), inside or tag == "article"
    skipped = skipped or tag in ("nav", "aside") or name in ("cookie-bar", "ad")
    if name == "share-holder-report":
        path, doubtful = (*path, "?"), True
    if isinstance(children[0], tuple) and len(children[0]) == 3:
        return [x for c in children for x in _leaves(c, path, skipped, inside, doubtful)]
    text = "".join(c if isinstance(c, str) else c[1] for c in children).strip()
    linked = all(isinstance(c, tuple) for c in children)
    heading = tag == "h2"
    return [] if skipped else [((*path, "a") if linked else path, text, inside, linked, doubtful, heading)]


def _plain(tree):
    leaves = _leaves(tree)
    if not leaves:
        return ""
    order = list(dict.fromkeys(x[0] for x in leaves))
    texts = [[x[1] for x in leaves if x[0] == p] for p in order]
    long = [sum(map(len, t)) / len(t) for t in texts]
    dots = [sum(len(re.findall(r"[^\w\s]", x)) for x in t) / len(t) + 1e-9 for t in texts]
    near = lambda v, k: v[k] if len(v) == 1 else 0.8 * v[k] + 0.1 * (v[max(k - 1, 0)] + v[min(k + 1, len(v) - 1)])
    fused = [(near(long, k) * near(dots, k)) ** 0.5 for k in range(len(order))]
    spread = float(np.std(fused))
    high = lambda p, f: fused[order.index(p)] >= min(f * spread, max(fused)) - 1e-9
    marked = any(x[2] for x in leaves)
    kept = [x[2] and (high(x[0], 0.5) if x[4] else not x[3] or high(x[0], 0.1)) if marked else high(x[0], 0.5) for x in leaves]
    for k in range(len(leaves) - 2, -1, -1):
        kept[k] = kept[k] or leaves[k][5] and (leaves[k][2] or not marked) and kept[k + 1]
    return "\n".join(x[1] for x, ok in zip(leaves, kept, strict=True) if ok)


@pytest.mark.parametrize("marked", [False, True])
def test_pages_match_plain_ratios(marked):
    rng, dropped = random.Random(marked), 0
    for _ in range(300):
        body = ("body", "", [_tree(rng) for _ in range(3)] + [("article", "", [_tree(rng, 1) for _ in range(4)])] * marked)
        want = _plain(body)
        assert html.extract(_markup(body)) == want
        dropped += len(want.split("\n")) < len([x for x in _leaves(body) if x[2] or not marked])
    assert dropped > 10


def test_deep_and_broken_pages():
    deep = html.extract("<div>x, y. " * 30_000)
    assert deep.count("\n") == 29_999
    assert html.extract('<article><p title="a>Hello there, friend.</p><p>Second, one.</p></article>') == "Hello there, friend.\nSecond, one."
    assert html.extract("<article><p>One, two.</p><svg/><p>Three, four.</p><template><iframe src=x><p>Five, six.</p></article>") == "One, two.\nThree, four.\nFive, six."
    report = "<article><p>One, two; three.</p><div class='share-holder-report'><p>Those who hold shares, all of them, agreed.</p></div><div class='share-buttons'><p>Tell others, now.</p></div></article>"
    assert html.extract(report) == "One, two; three.\nThose who hold shares, all of them, agreed."


# Languages and the word model without caps


def test_more_than_64_languages(spark):
    rng = random.Random(12)
    syllables = {f"l{k:02d}": ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=2)) + rng.choice("aeiou") for _ in range(4)] for k in range(70)}
    rows = [(i, " ".join("".join(rng.choices(s, k=3)) for _ in range(30)), lang, "s", 1) for i, (lang, s) in enumerate(list(syllables.items()) * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = language.train(df)
    assert len(model.languages) == 70 and model.slots.shape[1] == 2
    assert sum(model.predict(r[1])[0] == r[2] for r in rows) / len(rows) > 0.98


def test_scores_match_exact_sets(spark):
    """The filter's shares against sets of n-grams, kept by the same rule."""
    rng = random.Random(15)
    syllables = {"aa": "tor vek lun mir".split(), "bb": "tor pel shi mio".split(), "cc": "gru dax wyn lun".split()}
    rows = [(i, " ".join("".join(rng.choices(s, k=rng.randint(1, 3))) for _ in range(rng.randint(1, 40))), lang, "s", 1) for i, (lang, s) in enumerate(list(syllables.items()) * 30)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    counts = {lang: {} for lang in syllables}
    for _, text, lang, _, _ in rows:
        for g in language.grams(language.letters(text)).tolist():
            counts[lang][g] = counts[lang].get(g, 0) + 1
    counts = {lang: {g: n for g, n in c.items() if n >= 3} for lang, c in counts.items()}
    rates = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    sets = {lang: {g for g, r in c.items() if r >= 0.25 * max(x.get(g, 0) for x in rates.values())} for lang, c in rates.items()}
    for text in [r[1] for r in rows[:40]] + ["tor", "xyz qq", "Vek-LUN 3 mio"]:
        own = language.grams(language.letters(text))
        exact = [sum(g in sets[lang] for g in own.tolist()) / len(own) for lang in model.languages]
        assert model.scores(own) == pytest.approx(exact, abs=1e-3)
        if sum(exact):
            lang, score, coverage = model.predict(text)
            assert (lang, score, coverage) == (model.languages[int(np.argmax(exact))], pytest.approx(max(exact) / sum(exact), abs=1e-3), pytest.approx(max(exact), abs=1e-3))


def test_stretches_of_a_long_text_are_exact(spark, monkeypatch):
    rng = random.Random(9)
    model, _ = markov.fit(docs_of(spark, [prose(rng, n) for n in (5, 70, 200)] * 4))
    ids = [model.symbols(markov.words(prose(rng, n)))[0] for n in (1000, 130, 64)]
    whole = [(markov.forward(model, markov.Blocks([x]))[0], markov.expected(model, markov.Blocks([x]))) for x in ids]
    monkeypatch.setattr(markov, "TOKENS_AT_ONCE", 100)
    for x, (likely, sums) in zip(ids, whole, strict=True):
        assert markov.likelihood(model, [x]) == pytest.approx(likely)
        assert markov.counts_of(model, [x]) == pytest.approx(sums)
    parts = list(markov._gathered(iter(ids + ids[1:]), len))
    assert [len(p) for p in parts] == [1, 1, 1, 1, 1] and sum(map(len, parts)) == 5


def test_ties_leave_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(markov, "FREQUENT", 64)
    model, rest = markov.fit(docs_of(spark, [" ".join(f"w{k}" for k in range(1000))]))
    assert 30 < len(model.index) < 110 and len(model.index) + rest.count() == 1000


def _plain_overlaps(doc, item):
    """matched and hits over all alignments that share a seed, by plain loops."""
    from sonolith.llm import decontaminate as C

    best, hits = 0.0, 0
    for shift in range(-len(item) + 1, len(doc)):
        low, high = max(0, shift), min(len(doc), shift + len(item))
        same = [doc[i] == item[i - shift] for i in range(low, high)]
        if len(item) < C.SPAN:
            own = int(len(same) == len(item) and all(same))
        else:
            own = sum(all(same[i + j] for j, b in enumerate(m) if b == "1") for m in C.MASKS for i in range(len(same) - C.SPAN + 1))
        size = min(C.WINDOW, len(same))
        if own and size >= min(C.LEAST_WINDOW, len(item)):
            share = max(sum(same[k : k + size]) for k in range(len(same) - size + 1)) / size
            if share >= C.LEAST_SHARE:
                best, hits = max(best, share), hits + own
    return best, hits


def test_decontamination_of_repeated_words(spark):
    """Runs of equal words on either side have all their alignments and hits, by a broadcast and by a shuffle."""
    import random

    from sonolith.llm import decontaminate as C

    rng = random.Random(4)
    docs = ["w " * 60, "a b " * 30, "x " + "w " * 25 + "y z " + "w " * 14, "w w w b w w w w w w w w w w " * 3, "w " * 9, "q r s " * 9]
    docs += [" ".join(rng.choice("wwwwb") for _ in range(50)) for _ in range(12)]
    items = ["w " * 40, "w " * 15 + "b " + "w " * 12, "b " * 12, "w " * 5, "a b " * 10, " ".join(rng.choice("wwwwwb") for _ in range(30))]
    held = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    for d, x in enumerate(docs):
        for k, y in enumerate(items):
            found = _plain_overlaps(x.split(), y.split())
            if found[1]:
                want[d, k] = found
    assert want
    for most in (16, 0):
        got = {(r["doc_id"], r["item_id"]): (r["matched"], r["hits"]) for r in C.overlaps(held, bench, most_blocks=most).collect()}
        assert got == want


def test_decontamination_grows_with_a_repeated_word(spark):
    """A text of 20,000 equal words meets an item of 40 at as many alignments as both have words."""
    from sonolith.llm import decontaminate as C

    held = spark.createDataFrame([(1, "w " * 20_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "w " * 40)], "item_id long, text string")
    (r,) = C.overlaps(held, bench).collect()
    assert (r["matched"], r["hits"]) == (1.0, 3 * 19_991 * 31 - _short_windows(C))


def _short_windows(C):
    """Hits of the alignments at a text's ends that have too few words to count."""
    return sum(2 * 3 * (n - C.SPAN + 1) for n in range(C.SPAN, C.LEAST_WINDOW))


def test_buckets_of_near_copies_are_split_no_further(spark):
    """A cluster of near copies went down every path, 31 rows a member, and met in all of them."""
    rng = np.random.default_rng(11)
    base = jaccard.mix(rng.integers(0, 2**63, 400).astype(np.uint64))
    rows = []
    for _ in range(600):
        s = base.copy()
        s[rng.integers(0, 400, 4)] = jaccard.mix(rng.integers(0, 2**63, 4).astype(np.uint64))
        rows.append((jaccard.digest(s), len(s), jaccard.signature(s).tobytes()))
    met = jaccard._met(spark.createDataFrame(rows, "key binary, size long, sign binary"))
    assert met.count() <= 600 * len(jaccard.root_choices())
    assert met.select("key").distinct().count() == 600


def test_buckets_of_half_alike_copies_are_split_once(spark, monkeypatch):
    """Copies that share 0.7 of their minima went down to the last depth, where as many comparisons were left."""
    rng = np.random.default_rng(12)
    base = jaccard.mix(rng.integers(0, 2**63, 400).astype(np.uint64))
    rows = []
    for _ in range(900):
        s = base.copy()
        s[rng.integers(0, 400, 36)] = jaccard.mix(rng.integers(0, 2**63, 36).astype(np.uint64))
        rows.append((jaccard.digest(s), len(s), jaccard.signature(s).tobytes()))
    made, keep = {}, jaccard.stable

    def counted(df, name):
        out = keep(df, name)
        made[name] = out.count() if name.startswith("jaccard-paths") else None
        return out

    monkeypatch.setattr(jaccard, "stable", counted)
    met = jaccard._met(spark.createDataFrame(rows, "key binary, size long, sign binary"))
    assert met.select("key").distinct().count() == 900
    assert made["jaccard-paths-2"] > 900
    assert made.get("jaccard-paths-3", 0) + made.get("jaccard-paths-4", 0) < 0.1 * made["jaccard-paths-2"]
