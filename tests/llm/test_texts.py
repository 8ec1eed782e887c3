import base64
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallywire.llm import chat, editembed, langid, linededup, ogg, registry, warc
from tallywire.llm.shared import shared_folder
from tests.llm import helpers
from tests.oracle import connect, rows_of, rows_of_sql


def test_sql_queries(spark, sf):
    con = connect(sf)
    for name, sql in registry.ORACLES.items():
        assert rows_of(registry.QUERIES[name](spark, sf)) == rows_of_sql(con, sql), name


def test_banded_distance(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(500):
        a = [rng.choice("abé") for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 20, 70]))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i, kind = rng.randint(0, len(b)), rng.random()
            if kind < 0.33 or not b:
                b.insert(i, rng.choice("abé"))
            elif kind < 0.66:
                b.pop(min(i, len(b) - 1))
            else:
                b[min(i, len(b) - 1)] = rng.choice("abé")
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for k in (1, 2, 3):
        for r in df.select("a", "b", linededup.banded_distance(F.col("a"), F.col("b"), k).alias("d")).collect():
            true = helpers.levenshtein(r.a, r.b)
            assert r.d == true if true <= k else r.d > k, (r, true)


def _near_lines(n):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(40)) + "." for _ in range(8)]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                line[rng.randrange(len(line))] = rng.choice("xyz")
            lines.append(" " * rng.randint(0, 2) + "".join(line))
            if rng.random() < 0.3:
                lines.append("short")
        docs.append((i, "\n".join(lines)))
    return docs


@pytest.mark.parametrize("crowd", [linededup.CROWD, 2])
def test_lines_against_all_pairs(spark, monkeypatch, crowd):
    """With crowded hashes joined as they are, and by bands of sketches."""
    monkeypatch.setattr(linededup.linked_lines, "__kwdefaults__", linededup.linked_lines.__kwdefaults__ | {"crowd": crowd})
    docs = _near_lines(60)
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_lines string")).collect()}
    places = [(i, k, line.strip(" ")) for i, t in docs for k, line in enumerate(t.split("\n")) if line.strip()]
    first = {}
    for i, k, line in places:
        first.setdefault(line, (i, k))
    long = [x for x in first if len(x) >= linededup.MIN_CHARS]
    linked = {a: [b for b in long if len(a) >= linededup.MIN_CHARS and a != b and helpers.levenshtein(a, b) <= linededup.THRESHOLD] for a in first}
    gone = {(i, k) for i, k, line in places if (i, k) > min(first[x] for x in [line, *linked[line]])}
    assert any(linked.values()) and gone
    for i, t in docs:
        lines = t.split("\n")
        kept = [x for k, x in enumerate(lines) if (i, k) not in gone]
        assert (got[i].text, got[i].n_lines, got[i].dropped_lines) == ("\n".join(kept), len(lines), len(lines) - len(kept))
        assert got[i].line_links == sum(len(linked[line]) for d, _, line in places if d == i)


def test_bands_of_template_lines(spark):
    """Lines of one template: bands keep every linked pair and leave few of the others to compare."""
    rng = random.Random(9)
    name = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = [f"Posted by {name(14)} on the day of {name(12)}, in the evening" for _ in range(400)]
    lines += [line.replace("evening", "evenings") for line in lines[::8]] + [line[:12] + "#" + line[13:] for line in lines[::10]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {(r.h, r.other) for r in linededup.linked_lines(df, crowd=50).collect()}
    assert len(got) == 2 * sum(helpers.levenshtein(a, b) <= 2 for i, a in enumerate(lines) for b in lines[:i] if a[:10] == b[:10] and abs(len(a) - len(b)) <= 1 and sum(map(str.__ne__, a[10:40], b[10:40])) <= 2)
    cut = df.select("doc_id", F.posexplode(linededup.bands(linededup.sketches(F.col("text")), 2)).alias("band", "bits"))
    met = cut.alias("a").join(cut.alias("b"), (F.col("a.band") == F.col("b.band")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.doc_id") < F.col("b.doc_id"))).count()
    assert met < 0.3 * len(lines) ** 2 / 2


@pytest.mark.parametrize("sieve", [linededup.SIEVE, 4])
def test_more_hashes_than_are_broadcast(spark, monkeypatch, sieve):
    """Where hashes are too many to be broadcast, pieces with their texts pass a sieve before they are shuffled; one that lets all pass
    changes no result."""
    docs = spark.createDataFrame([(i, f"{t}\nonly document {i} has this line {i * i}") for i, t in _near_lines(60)], "doc_id long, text string")
    want = rows_of(linededup.dedup_lines(docs))
    plans, keep = {}, linededup.written
    monkeypatch.setattr(linededup, "written", lambda df, name: plans.update({name: df}) or keep(df, name))
    monkeypatch.setattr(linededup, "BROADCAST_HASHES", 0)
    monkeypatch.setattr(linededup, "SIEVE", sieve)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # Spark would broadcast such a small table of its own accord
    try:
        assert rows_of(linededup.dedup_lines(docs)) == want
        lines = plans["members"]._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    depth = lambda line: len(re.match(r"[ :|+-]*", line)[0])
    met = []
    for at, line in enumerate(lines):
        if "Generate explode" in line:  # what stands above it
            top, above = depth(line), []
            for x in reversed(lines[:at]):
                if depth(x) < top:
                    top = depth(x)
                    above.append(x.lstrip(" :|+-").split(" ")[0])
            met.append(next(x for x in above if x in ("Exchange", "BroadcastHashJoin")))
    assert met
    assert set(met) == {"BroadcastHashJoin"}


def test_sieve(spark, monkeypatch):
    """All that are asked for pass, and few others."""
    monkeypatch.setattr(linededup, "SIEVE", 1 << 9)
    rows = spark.range(20_000).selectExpr("xxhash64(id) AS key", "id % 2 = 0 AS crowd", "id")
    asked = rows.filter("id < 1000").select("key", "crowd")
    passed = {r.id for r in linededup._sifted(rows, asked, ["key", "crowd"]).collect()}
    assert passed >= set(range(1000))
    assert len(passed) < 1000 + 0.02 * 19_000
    assert linededup._sifted(rows, asked.limit(0), ["key", "crowd"]).count() == 0


def test_lines_odd_tables(spark):
    line = "a line that is long enough to count"
    df = spark.createDataFrame([(1, None), (2, ""), (3, line), (3, line), (None, line), (4, line)], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.text, r.n_lines, r.dropped_lines) for r in linededup.dedup_lines(df).collect() if r.text is not None)
    assert rows == [(0, line, 1, 0), (2, "", 1, 0), (3, "", 1, 1), (3, "", 1, 1), (4, "", 1, 1)]
    assert linededup.dedup_lines(df.limit(0)).collect() == []


def test_language_held_out(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in helpers.documents(sf.replace("sf0.001", "sf0.01"))}
    rows = langid.op3_language_id(spark, sf.replace("sf0.001", "sf0.01")).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_spans(sf):
    docs = [r for r in helpers.documents(sf.replace("sf0.001", "sf0.01")) if len(r["text"]) > 1000]
    texts = {x: [r["text"] for r in docs if r["lang"] == x] for x in ("en", "de", "fr")}
    model = langid.model_from({x: langid.bucket_counts(t[1:]) for x, t in texts.items()})
    first, second = texts["en"][0][:400], texts["de"][0][:400]
    lang, score, spans = langid.identify(model, [first + " " + second])[0]
    assert [s[2] for s in spans] == ["en", "de"] and abs(spans[0][1] - 400) < 40
    assert [x[0] for x in langid.identify(model, [None, "", "12 !?", "привет"])][:3] == ["und"] * 3
    assert langid.identify(langid.model_from({}), ["text"]) == [("und", 0.0, [])]
    # the bound that spares texts the full pass changes no label
    w = langid.words_of([first, second, first + second, "x", *texts["fr"][:5]])
    labels, at, scores = langid.label_words(model, w)
    for a, b in zip(at, [*at[1:], len(labels)]):
        assert (langid.viterbi(scores[a:b], langid.SWITCH) == labels[a:b]).all()


def _plain_labels(model, text, switch):
    """Words letter by letter, n-gram buckets by their rule, and Viterbi over every step and pair of languages."""
    m, k, out, i = 0xFFFFFFFF, len(model.languages), [], 0

    def bucket(h):
        h = (h ^ h >> 15) * 0x2C1B3C6D & m
        return h >> 32 - langid.BITS

    text = text or ""
    while i < len(text):
        if not text[i].isalpha():
            i += 1
            continue
        j = i
        while j < len(text) and text[j].isalpha():
            j += 1
        word = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in text[i:j]]
        padded, score = [0, *word, 0, 0], [0.0] * k
        for a, b, c, d in zip(padded, padded[1:], padded[2:], [*padded[3:], 0]):
            if b == 0:
                break
            three = a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D & m
            four = three + (d if c else 0) * 0x27D4EB2F & m
            score = [s + float(model.tri[bucket(three)][x]) + float(model.quad[bucket(four)][x]) for x, s in enumerate(score)]
        script = next((n for n, p, q in reversed(langid.SCRIPT_RANGES) if p <= ord(text[i]) <= q), "other")
        out.append((j - i, [s + float(model.script[langid.SCRIPTS.index(script)][x]) for x, s in enumerate(score)]))
        i = j
    if not out:
        return None
    best, back = list(out[0][1]), []
    for _, row in out[1:]:
        came = [max(range(k), key=lambda y: (best[y] - switch * (y != x), y == x, -y)) for x in range(k)]
        back.append(came)
        best = [best[came[x]] - switch * (came[x] != x) + row[x] for x in range(k)]
    label = max(range(k), key=best.__getitem__)
    labels = [label]
    for came in reversed(back):
        label = came[label]
        labels.append(label)
    letters = [0] * k
    for x, (n, _) in zip(labels[::-1], out):
        letters[x] += n
    main = max(range(k), key=letters.__getitem__)
    sums = [sum(row[x] for y, (_, row) in zip(labels[::-1], out) if y == main) for x in range(k)]
    return model.languages[main], letters[main] / sum(letters) / sum(math.exp(min(50, s - sums[main])) for s in sums)


def test_language_against_plain_form(sf):
    docs = helpers.documents(sf)
    langs = sorted({r["lang"] for r in docs if r["lang"]})
    model = langid.model_from({x: langid.bucket_counts([r["text"] for r in docs if r["lang"] == x and r["doc_id"] % 2]) for x in langs})
    texts = [r["text"][:2500] for r in docs[:80]] + [docs[i]["text"][:300] + " " + docs[i + 1]["text"][:300] for i in range(0, 40, 2)]
    texts += [None, "", "12 !", "x", "İstanbul \U00032100\U00032101 ab", "привет мир " * 3, "a" * 5000]
    for text, (lang, score, _) in zip(texts, langid.identify(model, texts)):
        want = _plain_labels(model, text, langid.SWITCH)
        assert (lang, score) == ("und", 0.0) if want is None else lang == want[0] and abs(score - min(1, want[1])) < 1e-3, text[:60]
    # a text's labels do not depend on the texts beside it
    assert langid.identify(model, texts * 30)[-len(texts) :] == langid.identify(model, texts)


def test_language_odd_tables(spark):
    assert langid.identify(langid.model_from({"en": langid.bucket_counts(["some text"])}), ["\U00032100" * 3])[0][0] == "en"
    rows = [(1, "ein deutscher Satz", "de", "x"), (2, "an English sentence", "en", "x"), (2, "an English sentence", "en", "x"), (3, None, "en", "x"), (4, "", None, None), (None, "12", "de", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(df)
    got = sorted((r.doc_id or 0, r.lang_pred) for r in langid.predict(df, model).collect())
    assert got == [(0, "und"), (1, "de"), (2, "en"), (2, "en"), (3, "und"), (4, "und")]
    kept = langid.in_language(df, model, least_score=0.4)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 2] and langid.in_language(df.limit(0), model, least_score=0.4).collect() == []
    none = langid.fit(df.limit(0))
    assert none.languages == [] and {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"} and langid.predict(df.limit(0), none).collect() == []


def test_ogg_round_trip():
    for data in [b"", b"a", b"x" * 576, b"y" * 577, bytes(range(256)) * 500]:
        media = ogg.store_bytes(data)
        samples, n, bad, begin, end = ogg.read_bytes(media)
        assert (begin, end) == (0, len(samples))
        assert n == len(data) and bad == 0 and samples == data + b"\xff" * (len(samples) - len(data)) and len(samples) % 576 == 0 and samples
        assert len({p.serial for p in ogg.read_pages(media)}) == 2
    streams, _ = ogg.demultiplex(media)
    packets = next(p for p in streams.values() if p[0].data.startswith(ogg.SAMPLES))
    ends = [p.end for p in packets[1:]]
    assert ends == [min(4608 * (i + 1), len(samples)) for i in range(len(ends))] and packets[1].begin == 0
    broken = bytearray(media)
    broken[len(media) // 2] ^= 1
    assert ogg.read_bytes(bytes(broken))[2] == 1
    # a stream of samples is told by its head packet, whatever its serial number; others tell only where pages end
    head = ogg.SAMPLES + bytes(6)
    odd = b"".join(ogg.stream_pages(7, [head, b"x" * 100, b"y" * 50], [0, 1100, 1150]) + ogg.stream_pages(8, [b"other", b"z", b"w"], [0, 5, 9]))
    streams = ogg.demultiplex(odd)[0]
    assert [(p.begin, p.end) for p in streams[7]] == [(0, 0), (1000, 1100), (1100, 1150)] and [(p.begin, p.end) for p in streams[8]] == [(0, 0), (None, None), (None, 9)]
    assert ogg.read_bytes(odd)[3:] == (1000, 1150) and ogg.features(b"a" * 150, 1000, 1150).startswith("18,")


def test_ogg_tables(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "é" * 3000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.begin_granule, r.end_granule, r.bad_pages) for r in ogg.read(ogg.store(df)).collect())
    assert got == [(0, 6000, 0, 6336, 0), (1, 0, 0, 576, 0), (2, 0, 0, 576, 0), (2, 0, 0, 576, 0)]
    assert [r.payload for r in ogg.read(spark.createDataFrame([(1, None)], "doc_id long, media binary")).collect()] == [None]
    sound = ogg.packets(ogg.store(df.filter("doc_id is null"))).filter("end_s > 0").orderBy("packet").collect()
    assert [(r.begin_s, r.end_s, len(r.data)) for r in sound] == [(0.0, 0.576, 4608), (0.576, 0.792, 1728)]
    for empty in (ogg.read(ogg.store(df.limit(0))), ogg.packets(ogg.store(df.limit(0)))):
        assert empty.collect() == []


def test_ogg_checksum():
    """The polynomial, bit by bit."""
    data, crc = bytes(range(50)), 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    assert ogg.checksum(data) == crc


def test_ogg_query(spark, sf):
    texts = {r["doc_id"]: r["text"].encode() for r in helpers.documents(sf)}
    for r in ogg.op5_ogg(spark, sf).collect():
        payload = texts[r.doc_id] + b"\xff" * ((-len(texts[r.doc_id])) % 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_warc(spark):
    rows = [(5, "http://a", "same"), (3, None, "same"), (3, None, "same"), (9, "u\r\nv", "other"), (None, "n", "same"), (2, "x", None), (1, "y", ""), (7, "z", "é")]
    path = shared_folder(spark, "test")
    warc.write_archives(spark.createDataFrame([r + ("e",) for r in rows], "page_id long, url string, html string, digest string"), path)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, path).collect())
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(0, "revisit", 3, 4, sha("same")), (1, "response", None, 0, sha("")), (2, "revisit", 1, 0, sha("")), (3, "response", None, 4, sha("same")), (3, "response", None, 4, sha("same"))]
    want += [(5, "revisit", 3, 4, sha("same")), (7, "response", None, 2, sha("é")), (9, "response", None, 5, sha("other"))]
    assert got == want


def test_chat_odd_tables(spark):
    rows = [(1, 0, "user", "\\<s>[INST]\\b \\l"), (1, 1, "assistant", None), (1, 1, "assistant", "x<|turn|>\n"), (1, 2, None, "t"), (None, 0, "user", "n"), (1, 2, None, "t")]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame([r + (0,) for r in rows], "conv_id long, turn long, role string, text string, said int")).select("conv_id", "formatted", chat.read_chats(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", "\\<s>[INST]\\b \\l"), ("assistant", ""), ("assistant", "x<|turn|>\n"), ("", "t"), ("", "t")]
    assert out[1].loss == "x<|turn|>\n" and out[1].formatted.count("<|start|>") == 3 and "[INST]" not in out[1].formatted
    assert [tuple(t) for t in out[None].turns] == [("user", "n")]


def test_fingerprint_brute_force():
    import numpy as np

    rng = random.Random(2)
    for n in (0, 1, 2, 50, 700):
        text = "".join(rng.choice("abc é\U0001f600") for _ in range(n))
        written, j = [], 0
        for c in text:
            kind = int(editembed.classes(np.array([ord(c)], dtype=np.uint32))[0])
            stay = int(editembed.stays()[(j % editembed.PERIOD) * editembed.CLASSES + kind])
            written += [c] * stay
            j += stay
        digits = [int(editembed.mix(np.array([ord(written[[x for x in s.tolist() if x < len(written)][-1]]) * editembed.SAMPLES + b], dtype=np.uint64))[0]) >> 60 for b, s in enumerate(editembed.series())] if text else []
        assert editembed.fingerprints([text, "pad"] * 30)[0] == "".join(f"{x:x}" for x in digits)


def test_fingerprint_query(spark, sf):
    docs = sorted((r["doc_id"], r["text"]) for r in helpers.documents(sf))
    rows = {r.doc_id: r for r in editembed.op9_fingerprints(spark, sf).collect()}
    assert len(rows) == len(docs)
    for i, (key, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = rows[key]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = editembed.fingerprints([text, edited, after])
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (a, b, editembed.likeness(a, b), editembed.likeness(a, c))
    same = {}
    for r in rows.values():
        same.setdefault(r.fingerprint, []).append(r)
    assert all(r.near_id == x[0].near_id <= r.doc_id for x in same.values() for r in x if r.fingerprint) and all(rows[r.near_id].near_id == r.near_id for r in rows.values() if r.n_chars)
    long = [r for r in rows.values() if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


def _prints(spark, rows):
    prints = editembed.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"))
    return prints.select("doc_id", F.unhex("fingerprint").alias("fingerprint"))


def test_near_classes(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(400)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t) for i, t in enumerate(base[:6])] + [(200 + i, t[:390] + "xyz" + t[393:]) for i, t in enumerate(base[:6])] + [(300, None), (301, ""), (None, base[0])]
    got = {(r.doc_id, r.near_id) for r in editembed.near_classes(_prints(spark, rows)).collect()}
    assert got == {(100 + i, i) for i in range(6)} | {(200 + i, i) for i in range(6)}
    assert editembed.near_classes(_prints(spark, rows).limit(0)).collect() == []


def test_near_classes_keep_texts_of_one_id_apart(spark):
    """Two unlike texts of one id do not join the classes of their copies."""
    rng = random.Random(11)
    a, b = ("".join(rng.choice("abcdefghij ") for _ in range(400)) for _ in range(2))
    rows = [(1, a), (2, b), (5, a[:390] + "xyz" + a[393:]), (5, b[:390] + "xyz" + b[393:]), (6, "another text, like nothing else here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = editembed.near_classes(_prints(spark, rows)).collect()
    assert sorted((r.doc_id, r.near_id) for r in got) == [(5, 1), (5, 2)]
    whole = editembed.edited_and_next(df, near=True).collect()
    assert sorted((r.doc_id, r.near_id) for r in whole) == [(1, 1), (2, 2), (5, 1), (5, 2), (6, 6)]


def test_near_classes_lose_no_link(spark):
    """Pairs at the threshold whose differences lie where every band begins, and pairs one sample beyond it."""
    import numpy as np

    order = editembed.mix(np.arange(editembed.BANDS * editembed.SAMPLES, dtype=np.uint64) + np.uint64(0xBA9D)).reshape(editembed.BANDS, editembed.SAMPLES).argsort(axis=1)
    begins, rng = sorted({int(p) for p in order[:, 0]}), np.random.default_rng(5)
    rows = []
    for n, differ in enumerate([48] * 30 + [49] * 30):
        a = rng.integers(0, 16, editembed.SAMPLES)
        others = rng.permutation([p for p in range(editembed.SAMPLES) if p not in begins]).tolist()
        b = a.copy()
        at = begins + others[: differ - len(begins)]
        b[at] = (b[at] + rng.integers(1, 16, len(at))) % 16
        rows += [(2 * n + k, (x[::2] << 4 | x[1::2]).astype(np.uint8).tobytes()) for k, x in enumerate((a, b))]
    got = {(r.doc_id, r.near_id) for r in editembed.near_classes(spark.createDataFrame(rows, "doc_id long, fingerprint binary")).collect()}
    assert got == {(2 * n + 1, 2 * n) for n in range(30)}


def test_near_classes_of_large_groups(spark):
    """Groups of hundreds of near copies: recall of links against all pairs."""
    rng = random.Random(4)
    rows = []
    for size, edits in ((300, 3), (150, 12), (80, 25)):
        base = [rng.choice("abcdefghij ") for _ in range(500)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(edits)):
                copy[rng.randrange(500)] = rng.choice("xyz")
            rows.append((len(rows), "".join(copy)))
    prints = dict(_prints(spark, rows).collect())
    links = [(a, b) for a in prints for b in range(a) if editembed.likeness(prints[a].hex(), prints[b].hex()) >= 0.8]
    near = {r.doc_id: r.near_id for r in editembed.near_classes(_prints(spark, rows)).collect()}
    whole = helpers.components(list(prints), links)
    assert sum(near.get(a, a) == near.get(b, b) for a, b in links) >= 0.9 * len(links)
    assert all(whole[near.get(i, i)] == whole[i] for i in prints) and sum(near.get(i, i) == whole[i] for i in prints) >= 0.9 * len(prints)


def _digits(rows):
    import numpy as np

    return [(i, (x[::2] << 4 | x[1::2]).astype(np.uint8).tobytes()) for i, x in enumerate(rows)]


def _changed(rng, x, n):
    x, at = x.copy(), rng.permutation(editembed.SAMPLES)[:n]
    x[at] = (x[at] + rng.integers(1, 16, n)) % 16
    return x


def test_classes_just_below_the_threshold_are_not_paired_by_members(spark, monkeypatch):
    """A class of 90 and 40 unlike rows that share keys with all of it: pairs do not grow with their product."""
    import numpy as np

    rng, made, real = np.random.default_rng(6), [], editembed.written
    base = rng.integers(0, 16, editembed.SAMPLES)
    rows = [_changed(rng, base, int(rng.integers(3, 8))) for _ in range(90)] + [_changed(rng, base, 85) for _ in range(40)]

    def counted(df, name, *more):
        out = real(df, name, *more)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(editembed, "written", counted)
    got = {(r.doc_id, r.near_id) for r in editembed.near_classes(spark.createDataFrame(_digits(rows), "doc_id long, fingerprint binary")).collect()}
    assert got == {(i, 0) for i in range(1, 90)}
    assert sum(made[2:]) < 90 * 40 / 4


def test_rounds_of_near_classes_do_not_repeat_members(spark, monkeypatch):
    """A class of 90 goes through the contractions once, not again in each round that follows."""
    import numpy as np

    from tallywire.llm import graph

    rng, made, real = np.random.default_rng(8), [], graph.written
    base = rng.integers(0, 16, editembed.SAMPLES)
    rows = [_changed(rng, base, int(rng.integers(3, 8))) for _ in range(90)]

    def counted(df, name, *more):
        out = real(df, name, *more)
        if name == "edges":
            made.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    got = {(r.doc_id, r.near_id) for r in editembed.near_classes(spark.createDataFrame(_digits(rows), "doc_id long, fingerprint binary")).collect()}
    assert got == {(i, 0) for i in range(1, 90)}
    assert sum(made) < 4 * 90


def test_near_classes_by_clusters_lose_no_link(spark, monkeypatch):
    """Bands that find the closest copies only leave many classes, of clusters with members far from their centre; classes are still those of
    all pairs."""
    import numpy as np

    monkeypatch.setattr(editembed, "EQUAL", 15)
    rng, rows = np.random.default_rng(7), []
    for _ in range(12):
        begin = rng.integers(0, 16, editembed.SAMPLES)
        for _ in range(4):  # each group goes on from a member of the last: some within reach, some just beyond
            group = [_changed(rng, begin, int(n)) for n in rng.integers(0, 25, 6)]
            rows += group
            begin = _changed(rng, group[int(rng.integers(6))], int(rng.integers(36, 56)))
    table = np.array(rows)
    differ = (table[:, None] != table[None]).sum(axis=2)
    links = [(a, b) for a in range(len(rows)) for b in range(a) if differ[a, b] <= 48]
    whole = helpers.components(list(range(len(rows))), links)
    got = {r.doc_id: r.near_id for r in editembed.near_classes(spark.createDataFrame(_digits(rows), "doc_id long, fingerprint binary")).collect()}
    assert {i: got.get(i, i) for i in whole} == whole and 12 < len(set(whole.values())) < 48


def test_edited_odd_tables(spark):
    rows = editembed.edited_and_next(spark.createDataFrame([(5, None, 1)], "doc_id long, text string, n_chars int")).collect()
    assert [(r.doc_id, r.n_chars, r.fingerprint, r.near_edited, r.near_next) for r in rows] == [(5, 0, "", 1.0, 1.0)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert editembed.edited_and_next(empty).collect() == [] == editembed.edited_and_next(empty, near=True).collect()
    rows = editembed.edited_and_next(spark.createDataFrame([(None, "ab"), (None, "ab"), (3, ""), (4, "x" * 200_000)], "doc_id long, text string"), near=True).collect()
    assert sorted((r.doc_id or 0, r.n_chars, r.near_id) for r in rows) == [(0, 2, None), (0, 2, None), (3, 0, None), (4, 200_000, 4)]
