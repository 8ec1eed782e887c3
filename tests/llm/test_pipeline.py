import numpy as np
import public_tokenizers as P

import corpus_pipeline
from tallywire.llm import linededup
from tests.llm import helpers
from tests.oracle import rows_of


def test_stages(spark, sf):
    """Each stage on what its predecessor kept, against plain forms of its rules."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.written(stage(spark, tables[-1], sf), name)
        tables.append(path)
    before, language, lines, copies, packed = tables
    assert all(t.columns == docs.columns for t in tables[:4])
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables[:4]]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] and len(ids[1]) > 0.9 * len(ids[0])
    texts = {r.doc_id: r.text for r in lines.collect()}
    sets = {i: helpers.shingles(t, 5) for i, t in texts.items()}
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = helpers.components(sets, near)
    assert ids[3] == {i for i in sets if group[i] == i}
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {}
    for r in packed.collect():
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert set(got) == ids[3]
    for i in list(ids[3])[:50]:
        assert np.frombuffer(b"".join(x for _, x in sorted(got[i])), "<u4").tolist() == whole.encode(texts[i], add_special_tokens=False).ids + [2]


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def test_copies_with_short_lines_go(spark):
    long = "a line that is long enough to be compared, number "
    rows = [(1, f"Head\n{long}one\n\nEnd"), (2, f"Head\n{long}one\n\nEnd"), (3, f"Mine\n{long}one\n\t\nEnd"), (4, "\n \n"), (5, None)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 3: "Mine\n\t", 4: "\n \n", 5: None}


def test_lines_beyond_the_broadcast_limit(spark, sf, monkeypatch):
    """The second stage keeps the same documents where hashes are too many to be broadcast, and its texts pass a sieve before a shuffle."""
    docs, plans, keep = spark.read.parquet(f"{sf}/documents.parquet"), {}, linededup.written
    want = rows_of(corpus_pipeline.lines(spark, docs, sf))
    monkeypatch.setattr(linededup, "written", lambda df, name: plans.update({name: df}) or keep(df, name))
    monkeypatch.setattr(linededup, "BROADCAST_HASHES", 0)
    assert rows_of(corpus_pipeline.lines(spark, docs, sf)) == want
    assert "BroadcastHashJoin [_word" in plans["members"]._jdf.queryExecution().executedPlan().toString()
