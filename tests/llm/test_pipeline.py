"""The pipeline against a plain version of its stages over planted cases."""

import os
import random

import pytest

import corpus_pipeline
from sonolith.llm import mixing

WORDS = [a + b for a in "bor vek lun gra sho mip".split() for b in "tan del fir gos hum jak".split()]


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))
    passage = prose(40)
    texts = [prose(rng.randint(30, 60)) for _ in range(40)]
    texts[3] = prose(90)  # long enough for one changed word to leave 0.8
    texts.append("12 34 -- !!")  # no language
    copy = texts[3].split()
    copy[5] = "changed"
    texts += [texts[2], " ".join(copy + ["more"])]  # an exact and a near copy
    texts.append(prose(10) + " " + passage + " " + prose(5))
    texts.append(prose(20) + " password=Qw3rTy9LkJh2 " + prose(20))
    rows = [(i, t, "xx", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r for r in now.collect()}
    everything = set(range(len(texts)))
    kept = everything - {40}
    assert set(seen["language_id"]) == kept
    kept -= {41, 42}
    assert set(seen["jaccard_join"]) == kept
    kept -= {43}
    assert set(seen["decontaminate"]) == kept
    clean = seen["secret_scan"]
    assert set(clean) == kept
    for i in kept:
        want = texts[i].replace("password=Qw3rTy9LkJh2", "[REDACTED]")
        assert clean[i]["text"] == want and clean[i]["n_chars"] == len(want)
    mix = seen["mix_sources"]
    sizes = {i: len(clean[i]["text"].split()) for i in kept}
    assert set(mix) <= kept and all(r["size"] == sizes[i] and r["taken"] == r["copies"] * r["size"] > 0 for i, r in mix.items())
    total = sum(sizes.values())
    for k in range(3):  # weights 1, 2, 3; no source is capped here
        got = sum(r["taken"] for r in mix.values() if r["source"] == f"s{k}")
        assert abs(got - total * (k + 1) / 6) <= 60
    whole = {(r["doc_id"], r["copies"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {(i, r["copies"]) for i, r in mix.items()}
    assert mixing.MAX_REPEATS == 3


FOLDER = "/root/testdata/sf0.01"
FOREIGN = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
    "sw": "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах",
}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_texts_of_languages_never_learned_are_dropped(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    planted = [(-1 - k, text, lang, "s") for k, (text, lang) in enumerate((t, label) for t in FOREIGN.values() for label in (None, "en"))]
    both = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language_id"](spark, both, FOLDER).select("doc_id").collect()}
    assert kept == ids
