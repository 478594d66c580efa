"""Every operator over odd and over empty tables."""

import pytest

from sonolith.llm import chat, decontaminate, html, jaccard, language, licenses, markov, mixing, secrets, webp

EACH = {
    "secrets": secrets.report,
    "language": language.report,
    "mixing": mixing.report,
    "webp": webp.report,
    "markov": markov.report,
    "licenses": licenses.scan,
    "jaccard": jaccard.report,
}
FILTERS = {"known": language.keep_known, "one_of_each": jaccard.one_of_each, "redact": secrets.redact}


@pytest.mark.parametrize("name", EACH)
def test_one_row_for_each_row(name, odd, empty):
    rows = EACH[name](odd).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in rows)
    assert ids == sorted((r["doc_id"] is None, r["doc_id"]) for r in odd.collect())
    twice = [r for r in rows if r["doc_id"] == 1]
    assert name == "mixing" or twice[0] == twice[1]
    assert EACH[name](empty).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(name, odd, empty):
    got = FILTERS[name](odd)
    assert got.columns == odd.columns
    assert got.count() <= odd.count()
    assert FILTERS[name](empty).count() == 0


def test_decontaminate(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, None), (2, ""), (3, "the quick brown fox jumps over the lazy dog near the old river bank"), (4, "word"), (4, "word")], "item_id long, text string")
    assert decontaminate.report(odd, none).count() == 0
    assert decontaminate.report(empty, some).count() == 0
    assert {r["doc_id"] for r in decontaminate.report(odd, some).collect()} == {1, 5, 6, 8}
    kept = decontaminate.clean(odd, some)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "4", "7", "None"]


def test_defined_values(odd):
    by = {r["doc_id"]: r for r in language.report(odd).collect()}
    assert language.Model(["en"], language.np.zeros(language.SLOTS, language.np.uint64), language.np.zeros(1)).predict("\U0001f600 12")[0] == "und"
    assert by[2]["lang_pred"] == by[3]["lang_pred"] == by[4]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in by.values())
    by = {r["doc_id"]: r for r in webp.report(odd).collect()}
    assert by[2]["payload_bytes"] == 64 and by[2]["payload_sha256"] == by[3]["payload_sha256"] and by[2]["n_bytes"] == 0
    by = {r["doc_id"]: r for r in markov.report(odd).collect()}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == 1
    by = {r["doc_id"]: r for r in jaccard.report(odd).collect()}
    assert by[2]["class_id"] == by[3]["class_id"] == 2 and by[2]["n_links"] == 1
    assert by[8]["class_id"] == by[1]["class_id"] == 1
    assert len(jaccard.one_of_each(odd).collect()) == len({r["class_id"] for r in jaccard.report(odd).collect()})


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (None, "u", "<div>One, two. Three"), (3, "u", "<p>")]
    got = html.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, 0, None, "x"), (None, None, "assistant", "y"), (2, 1, "assistant", "<|im_end|>" * 500)]
    got = {r["conv_id"]: r for r in chat.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1]["n_turns"] == 2 and got[None]["n_turns"] == 2 and got[None]["loss_chars"] == 1 and got[2]["loss_chars"] == 5000
    assert set(chat.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).toPandas()["conv_id"]) == {-1}
