"""Mixes of sources with few documents, how often documents are taken over many draws, and training on long texts."""

import os

import numpy as np
import pandas as pd
import pytest

from sonolith.llm import language, mixing

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_sources_of_ten_documents_come_near_their_targets(spark):
    got = mixing.report(spark.read.parquet(f"{FOLDER}/documents.parquet")).toPandas()
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] % got["size"].where(got["size"] > 0, 1) == 0).all()
    for (target, size), own in got.groupby(["target", "source_size"]):
        assert own["size"].sum() == size and abs(own["taken"].sum() - target) <= 0.03 * target


def test_repair_changes_copies_within_their_bounds():
    size = np.array([1000.0, 300, 200, 90, 7])
    for miss in (-800.0, 650.0, 13.0, -290.0):
        copies = np.array([1, 2, 0, 3, 1])
        got = mixing.repair(copies, size, miss, 20.0)
        assert got.min() >= 0 and got.max() <= 3
        assert abs(miss + (got - copies) @ size) < abs(miss) or abs(miss) <= 20
    assert (mixing.repair(np.array([3, 3]), size[:2], -5000.0, 1.0) == [3, 3]).all()
    assert len(mixing.repair(np.zeros(0, int), np.zeros(0), 10.0, 1.0)) == 0


def test_documents_are_taken_as_often_as_their_probability_says():
    """Over many draws, each flying document by its probability, and the tokens of the source always."""
    rng = np.random.default_rng(8)
    size = np.sort(rng.integers(20, 2000, 80))[::-1]
    part = pd.DataFrame({"size": size, "p": 0.37, "whole": 1, "target": 1.37 * size.sum(), "source": "s", "bucket": 0})
    run, total, draws = mixing._flight(True, mixing.LADDER), np.zeros(80), 600
    for seed in range(draws):
        got = run(part.assign(h=rng.integers(-(2**62), 2**62, 80))).sort_values("size", ascending=False, kind="stable")
        taken = ((got["whole"] + got["p"]) * got["size"]).sum()
        assert abs(taken - 1.37 * size.sum()) < 0.005 * 1.37 * size.sum()
        total += (got["whole"] + got["p"] - 1).to_numpy()
    share = total / draws
    flown = np.setdiff1d(np.arange(80), mixing.ladder(size.astype(float)))
    assert np.abs(share[flown] - 0.37).max() < 5 * (0.37 * 0.63 / draws) ** 0.5
    assert abs(share.mean() - 0.37) < 0.02


def test_training_counts_text_by_text(spark, monkeypatch):
    rows = [(i, "der die das und " * (i % 7 + 1) if i % 2 else "the and of to " * (i % 5 + 1), "de" if i % 2 else "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = language.train(docs)
    texts = [np.unique(language.grams(language.letters(t)), return_counts=True) for _, t, lang in rows if lang == "de"]
    held = language._summed("de", texts)
    codes, n = np.unique(np.concatenate([language.grams(language.letters(t)) for _, t, lang in rows if lang == "de"]), return_counts=True)
    assert (held["code"].to_numpy().view(np.uint64) == codes).all() and (held["n"] == n).all()
    monkeypatch.setattr(language, "MODEL_GRAMS", 20)
    small = language.train(docs)
    assert 0 < np.count_nonzero(small.slots) <= 20 * language.PROBES < np.count_nonzero(whole.slots)
    assert {small.predict(t)[0] for _, t, lang in rows if lang == "de"} == {"de"}
