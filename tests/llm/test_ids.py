"""Ids beyond 2^53 beside nulls, and ids that are strings, stay what they are."""

import pytest

import corpus_pipeline
from marlstone.llm import decontamination, html_extraction, language_id, line_dedup, minhash_dedup, sentencepiece_codec, toxicity

BIG = 2**53 + 1
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly box five dozen jugs of liquor before noon today"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(BIG, PROSE, "en"), (None, PROSE + " again", "en"), (BIG + 2, "um dois tres quatro cinco seis", "pt"), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)


def ids(frame, column="doc_id"):
    return sorted([r[0] for r in frame.select(column).collect()], key=lambda x: (x is not None, x))


ALL = [None, None, BIG, BIG + 2]


def test_rows_keep_their_ids(docs):
    assert ids(toxicity.predict(docs, toxicity.Matcher({}, toxicity.PRIOR))) == ALL
    assert ids(language_id.predict(docs, language_id.train(docs))) == ALL
    assert ids(sentencepiece_codec.token_digests(docs)) == ALL
    assert ids(sentencepiece_codec.decode(sentencepiece_codec.encode(docs))) == ALL
    assert ids(line_dedup.line_dedup(docs)) == ALL
    pages = docs.selectExpr("doc_id as page_id", "'u' as url", "concat('<article><p>', text, '</p></article>') as html")
    assert ids(html_extraction.extract(pages), "page_id") == ALL


def test_matches_and_classes_keep_ids(spark, docs):
    items = spark.createDataFrame([(BIG, PROSE), (None, "nothing of that kind stands in any of these texts at all")], "item_id long, text string").coalesce(1)
    found = decontamination.contaminated(docs, items)
    assert sorted(found.select("doc_id", "item_id").collect(), key=str) == sorted([(BIG, BIG), (None, BIG)], key=str)
    assert ids(decontamination.without_contaminated(docs, items)) == [None, BIG + 2]
    assert {(r["doc_id"], r["class_id"]) for r in minhash_dedup.near_duplicates(docs).collect()} == {(BIG, BIG), (None, BIG), (BIG + 2, BIG + 2), (None, None)}
    assert ids(minhash_dedup.one_of_each(docs)) == [None, BIG, BIG + 2]


def test_string_ids(spark):
    text = "one line here\nanother line there\na third line\nlast"
    docs = spark.createDataFrame([("b", text), ("a", text), (None, PROSE), ("c", PROSE + " again")], "doc_id string, text string")
    left = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(docs).collect()}
    assert left == {"a": 0, "b": 4, None: 0, "c": 0}
    assert {(r["doc_id"], r["class_id"]) for r in minhash_dedup.near_duplicates(docs).collect()} == {("a", "a"), ("b", "a"), (None, "c"), ("c", "c")}
    assert {r["doc_id"] for r in minhash_dedup.one_of_each(docs).collect()} == {"a", "c"}


def test_pipeline_columns_of_any_name(spark, docs):
    """Columns named like an operator's own stay what they are."""
    rows = docs.selectExpr("*", "'kept' as lang_pred", "7 as score", "8 as n_lines", "9 as n_removed", "2 as n_chars")
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.dedup_lines):
        got = stage(spark, rows, "")
        assert got.columns == rows.columns
        assert {(r["lang_pred"], r["score"], r["n_lines"], r["n_removed"]) for r in got.collect()} == {("kept", 7, 8, 9)}
