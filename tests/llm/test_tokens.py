import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallywire.llm import bpe, packing, tokencount
from tests.llm import helpers

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", "a", " \n\t ", "it's I'M we'll 'll", "é́ İstanbul ﬁ 한국 中文 123 ab12", "a<|endoftext|>b <|startoftext|>", "x\x1cy \x85 ΣΑΣ", "a" * 3000, "ab" * 999, "\U0001f600x" * 50, "...! ,.x"]


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash():
    rng = random.Random(8)
    sets = [[f"key{i}".encode() for i in range(n)] for n in (0, 1, 2, 7, 1000)]
    sets += [list({rng.randbytes(rng.randint(0, 12)) for _ in range(rng.randint(1, 200))}) for _ in range(500)]
    for keys in sets:
        h = bpe.PerfectHash(keys)
        assert sorted(map(h.slot, keys)) == list(range(len(keys))) and all(keys[h.slot_key[h.slot(k)]] == k for k in keys)
    with pytest.raises(ValueError):
        bpe.PerfectHash([b"a", b"b", b"a"])


def test_bpe_as_the_library(spark, sf, encoding):
    texts = ODD + [None] + [r["text"] for r in helpers.documents(sf)[:60]]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for r in bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH).collect():
        assert r.ids == encoding.encode_ordinary(texts[r.doc_id] or "") and bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).collect() == []


def test_counts_without_ids():
    vocabulary, rng = bpe.vocabulary(PATH), random.Random(4)
    pieces = ["".join(rng.choices("etaoin shrdé中\n'.17", k=rng.randint(1, 40))) for _ in range(3000)] + ["", "\U0001f600" * 8, "a" * 33]
    for piece in pieces:
        assert vocabulary.n_ids(piece) == len(vocabulary.ids(piece)), piece


def test_bpe_query(spark, sf, encoding):
    texts = {r["doc_id"]: r["text"] for r in helpers.documents(sf)}
    rows = bpe.op2_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows[::9]:
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_chunk_ids_as_the_library(sf):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole, chunks = Tokenizer.from_file(path), packing.ChunkIds(path, most=3000)
    for t in ODD + [r["text"] for r in helpers.documents(sf)[:80]]:
        assert np.frombuffer(chunks.encode([t])[0], "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t[:50]


def test_packing_query(spark, sf):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = packing.op4_packing(spark, sf).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d in helpers.documents(sf):
        ids = whole.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by_doc.pop(d["doc_id"]), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 4096 and (at == 4096 or at & (at - 1) == 0)


def test_whole_windows():
    rng = random.Random(1)
    for _ in range(100):
        sizes = [rng.randrange(1, 100) for _ in range(rng.randrange(0, 60))]
        windows = packing.whole_windows(sizes, 100)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and all(sum(sizes[i] for i in w) <= 100 for w in windows)
        pieces = packing.cut_windows(sizes, 64)
        assert sum(p[2] for w in pieces for p in w) == sum(sizes) and all((n := sum(p[2] for p in w)) == 64 or n & (n - 1) == 0 for w in pieces)
        at = {}
        for i, start, n in sorted(p for w in pieces for p in w):
            assert start == at.get(i, 0)
            at[i] = start + n
        assert at == {i: n for i, n in enumerate(sizes) if n}


def _plain_differencing(sizes, k):
    """With all k slots of every partition written out."""
    heap = [(-size, i, [(size, [i])] + [(0, [])] * (k - 1)) for i, size in enumerate(sizes)]
    n = len(sizes)
    while len(heap) > 1:
        heap.sort(key=lambda x: x[:2])
        (_, _, a), (_, _, b), *heap = heap
        merged = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda s: -s[0])
        merged = [(x - merged[-1][0], p) for x, p in merged]
        heap.append((-merged[0][0], n, merged))
        n += 1
    return sorted(sum(sizes[i] for i in p) for _, p in heap[0][2])


def test_the_count_rises():
    """Where the least count leaves a window above the capacity, more windows are made and none exceeds it."""
    assert len(packing.whole_windows([6, 6, 6, 6], 10)) == 4 and len(packing.whole_windows([5, 5, 5, 5], 10)) == 2
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(2, 40))]
        k = rng.randrange(2, 9)
        got = packing.differencing(sizes, k)
        assert len(got) == k and sorted(i for w in got for i in w) == list(range(len(sizes)))
        assert max(map(lambda w: sum(sizes[i] for i in w), got)) <= 1.25 * max(_plain_differencing(sizes, k))


def test_differencing_evens_out():
    sizes = [8, 7, 6, 5, 4]
    sums = sorted(sum(sizes[i] for i in w) for w in packing.differencing(sizes, 2))
    assert sums == [14, 16]


def test_packing_odd_tables(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a b", "z")], "doc_id long, text string, ids string")
    rows = packing.pack(df, P.path("word_bpe_49k.json")).collect()
    whole = {}
    for r in rows:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert whole == {None: 3, 1: 1, 2: 2}  # the closing id, and two words; a document may be cut anywhere
    assert {(r.doc_id, r.doc_tokens) for r in rows} == {(None, 3), (1, 1), (2, 1)}
    assert packing.pack(df.limit(0), P.path("word_bpe_49k.json")).collect() == []
    assert sum(r.length for r in packing.pack(df, P.path("word_bpe_49k.json"), cut=False).collect()) == 6


def test_count_tree():
    find, ids, rng = bpe.splitter(P.PATTERN).findall, bpe.piece_ids(PATH), random.Random(5)
    count, letters = (lambda p: len(ids[p])), "ab'st lvre d\n\t  .,1é X"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 10, 50, 900])))
        tree = tokencount.CountTree.planted(text, find, count)
        for _ in range(rng.randint(1, 6)):
            s = rng.randint(-2, len(text) + 3)
            e = s + rng.choice([0, 0, 1, 2, 5, 40])
            new = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 7])))
            a = min(max(s, 0), len(text))
            b = min(max(e, a), len(text))
            text = text[:a] + new + text[b:]
            tree.edit(s, e, new)
            assert tree.total == sum(map(count, find(text))) and tree.length == len(text)
            if rng.random() < 0.5:  # what is stored and loaded again is the same tree
                fresh = tokencount.CountTree(find, count).load(*tree.state())
                assert fresh.total == tree.total and (fresh.chars, fresh.tokens) == (tree.chars, tree.tokens)
                tree = fresh
                assert tree.sizes.tolist() == list(map(len, find(text))) and tree.chars[1] == sum(tree.chars[tree.width :]) and tree.tokens[1] == tree.counts.sum()
        assert tree.text() == text


def test_count_query(spark, sf, encoding):
    texts = {r["doc_id"]: r["text"] for r in helpers.documents(sf)}
    rows = tokencount.op10_token_counts(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        x = y = texts[r.doc_id]
        n = len(x)
        for a, b, new in ((n // 3, n // 3 + 24, x[n // 3 : n // 3 + 24].upper()), (n // 2, n // 2 + 7, ""), (0, 0, "It's 12 o'clock:\n "), (n + 1000, n + 1000, "  -- the end")):
            y = y[:a] + new + y[b:]
        assert (r.n_tokens, r.edited_tokens, r.edited_chars) == (len(encoding.encode_ordinary(x)), len(encoding.encode_ordinary(y)), len(y))
    long = [r for r in rows if r.n_pieces > 1000]
    assert all(r.encoded_again < 100 for r in long)


def test_batches_of_edits(spark, encoding):
    """Two batches of edits on stored trees: only documents with edits come out, counted as the library does."""
    rng = random.Random(6)
    letters = "ab'st lvre d\n\t  .,1é X"
    now = {i: "".join(rng.choice(letters) for _ in range(rng.choice([0, 5, 80, 3000]))) for i in range(30)}
    trees = tokencount.plant(spark.createDataFrame(list(now.items()), "doc_id long, text string"), PATH, P.PATTERN)
    for _ in range(2):
        table = []
        for i in rng.sample(sorted(now), 12):
            for k in range(rng.randint(1, 4)):
                start = rng.randint(0, len(now[i]))
                end, new = start + rng.choice([0, 1, 30]), "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 400])))
                table.append((i, k, start, end, new))
                now[i] = now[i][:start] + new + now[i][max(start, min(end, len(now[i]))) :]
        rng.shuffle(table)
        edits = tokencount.edits_by_document(spark.createDataFrame(table, "doc_id long, edit int, start long, end long, replacement string"))
        done = tokencount.apply_edits(trees, edits, PATH, P.PATTERN, keep_trees=True).persist()
        assert sorted(r.doc_id for r in done.collect()) == sorted({t[0] for t in table})
        for r in done.collect():
            assert (r.text, r.edited_tokens, r.edited_chars) == (now[r.doc_id], len(encoding.encode_ordinary(now[r.doc_id])), len(now[r.doc_id]))
        trees = trees.join(done.select("doc_id"), "doc_id", "left_anti").unionByName(done.select(trees.columns))
    assert trees.count() == 30


def test_count_odd_tables(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a b", "x")], "doc_id long, text string, n_tokens string")
    edits = F.when(F.col("doc_id") == 2, F.array(F.struct(F.lit(1).alias("start"), F.lit(9).alias("end"), F.lit(None).cast("string").alias("replacement")), F.lit(None)))
    trees = tokencount.plant(df, PATH, P.PATTERN)
    rows = {r.doc_id: r for r in tokencount.apply_edits(trees, F.when(F.col("text") != "", edits), PATH, P.PATTERN).collect()}
    assert tokencount.plant(df.limit(0), PATH, P.PATTERN).collect() == [] == tokencount.apply_edits(trees.limit(0), F.array(), PATH, P.PATTERN).collect()
    long = "ab 12\n" * 100_000
    whole = tokencount.plant(spark.createDataFrame([(None, long), (7, long)], "doc_id long, text string"), PATH, P.PATTERN)
    assert {r.encoded_again for r in tokencount.apply_edits(whole, F.array(F.struct(F.lit(300_000), F.lit(300_001), F.lit("x"))), PATH, P.PATTERN).collect()} < set(range(9))
    assert (rows[1].n_tokens, rows[1].edited_tokens, rows[2].edited_tokens, rows[2].edited_chars) == (0, 0, 1, 1)
