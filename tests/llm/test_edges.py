"""Odd tables: empty ones, nulls, repeated rows, very long texts, names that clash."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallywire.llm import chat, hostrules, infill, langid, lexical, warc
from tallywire.llm.shared import shared_folder

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_archives_and_chats(spark):
    path = shared_folder(spark, "empty")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).collect() == []
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, name):
    """Every stage: an empty table; nulls, repeated rows and columns whose names a stage uses itself."""
    stage = dict(corpus_pipeline.STAGES)[name]
    empty = spark.createDataFrame([], DOCUMENTS)
    assert stage(spark, empty, "").collect() == []
    words = "the quick brown fox jumps over the lazy dog and runs away from it all again and again"
    rows = [(i, f"{words} number {i} of them\n{words[i:]}", "en", "s", 9) for i in range(6)]
    rows += [(6, None, "en", None, None), (None, words + " here", None, "s", 1), (7, "", None, None, 0), (8, " \n ", "en", "s", 3), (0, rows[0][1], "en", "s", 9)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    for c in ("id", "component", "line", "labels", "ids"):
        docs = docs.withColumn(c, F.lit("clash"))
    out = stage(spark, docs, "")
    assert name == "packing" or out.columns == docs.columns
    found = out.collect()
    assert len(found) > 0 and {r.doc_id for r in found} <= {r[0] for r in rows}
    if name == "packing":
        assert {r.doc_id for r in found} == {r[0] for r in rows}
    elif name != "language":
        assert {6, 7, 8} <= {r.doc_id for r in found}  # nothing to lose


def test_very_long_texts(spark):
    """A text of some ten million characters beside short ones."""
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa. " * 170_000
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None)], "doc_id long, text string")
    docs = docs.unionByName(spark.range(1).select(F.lit(3).cast("long").alias("doc_id"), F.repeat(F.lit(long[:58]), 170_000).alias("text")))
    terms = lexical.item_terms(spark.createDataFrame([(1, "beta kappa")], "item_id long, text string"))
    found = lexical.search(lexical.build_index(docs), terms).collect()
    assert {r.doc_id for r in found} == {1, 3}
    made = {r.doc_id: (r.n, r.form) for r in infill.fill_in_middle(docs).select("doc_id", "n", "form").collect()}
    assert made[3][0] == len(long) and made[2] == (0, "plain")
    counted = {r.id: r for r in hostrules.counts(docs.withColumn("source", F.lit("s"))).collect()}
    assert counted[3].n_words == counted[3].n_repeat_words == 1_700_000 and counted[2].n_words == 0
    model = langid.fit(spark.createDataFrame([(i, f"alpha beta gamma {i}", "xx") for i in range(20)], "doc_id long, text string, lang string"))
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}[3] == "xx"
