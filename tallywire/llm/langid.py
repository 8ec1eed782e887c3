"""Language identification of whole texts and of spans within them.

A word is a run of letters of one text. Its script (by Unicode ranges) narrows the languages to those that wrote that
script in training; each language left gets a score from hashed letter n-grams. Viterbi over the words of a text, with
a penalty for each switch, labels spans; the language with most letters is the text's.

The path of a single language is the best one if no stretch of words gains more than the penalty under another
language. That bound is computed for all words of a batch at once, and only texts above it take the full Viterbi pass,
so the labels are the same.

Defined cases: texts that are null or without a letter are ``und`` with score 0 and no spans, and so is every text if
there is nothing to learn from; ties go to the language whose name sorts first; texts of any length are read whole;
repeated rows get one row each; extra columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.llm.arrow import id_type, map_steps, narrow, parts

UNKNOWN = "und"
# First and last code points of scripts, from the Unicode block list.
SCRIPT_RANGES = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
]
SCRIPTS = ["other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES)]

#: Hash bits of each n-gram table.
BITS = 16
#: Cost of a change of language between two words, in nats.
SWITCH = 12.0
#: What a word loses under a language that does not write its script.
FOREIGN = 30.0
#: N-grams overlap, so their log-likelihoods are scaled.
SCALE = 0.5
#: Rows of the training sample, as a bound on what is counted.
SAMPLE_ROWS = 12_000
#: Bytes of text that are scored together: a letter takes some tens of bytes.
RUN_BYTES = 1 << 20


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, its lower case, its script."""
    letter, lower = np.zeros(0x110000, dtype=bool), np.arange(0x110000, dtype=np.uint32)
    for i in (*range(0xD800), *range(0xE000, 0x110000)):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
    script = np.zeros(0x110000, dtype=np.uint8)
    for name, first, last in SCRIPT_RANGES:
        script[first : last + 1] = SCRIPTS.index(name)
    return letter, lower, script


@dataclass
class Words:
    """The words of a batch of texts: of each word its text, first and last code point, script; of each letter its two
    n-gram buckets; and where each word's letters begin."""

    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    script: np.ndarray
    first_letter: np.ndarray
    tri: np.ndarray
    quad: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    letter, lower, script = _tables()
    sizes = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    cp = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    where = np.flatnonzero(letter[cp])
    chars = lower[cp[where]]
    begins = np.ones(len(where), dtype=bool)
    begins[1:] = np.diff(where) > 1
    first = np.flatnonzero(begins)
    ends = np.roll(begins, -1)
    if len(ends):
        ends[-1] = True
    zero = np.uint32(0)
    left = np.where(begins, zero, np.roll(chars, 1))
    right = np.where(ends, zero, np.roll(chars, -1))
    far = np.where(ends, zero, np.roll(right, -1))
    mixed = left * np.uint32(0x9E3779B1) + chars * np.uint32(0x85EBCA77) + right * np.uint32(0xC2B2AE3D)
    four = mixed + far * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - BITS)
    spread = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift
    begin = where[first]
    last = where[np.append(first[1:], len(where)) - 1] + 1 if len(first) else begin
    text = np.searchsorted(starts, begin, side="right") - 1
    return Words(text, begin - starts[text], last - starts[text], script[cp[begin]], first, spread(mixed), spread(four))


def bucket_counts(texts: list[str | None]) -> np.ndarray:
    """Counts that a language is learnt from: trigram buckets, quadgram buckets, letters by script of their word."""
    w = words_of(texts)
    n = 1 << BITS
    letters = np.diff(np.append(w.first_letter, len(w.tri)))
    return np.concatenate([np.bincount(w.tri, minlength=n), np.bincount(w.quad, minlength=n), np.bincount(w.script, weights=letters, minlength=len(SCRIPTS))]).astype(np.float64)


@dataclass
class Model:
    languages: list[str]
    tri: np.ndarray  # bucket x language
    quad: np.ndarray
    script: np.ndarray  # script x language: 0, or minus FOREIGN


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the different texts among rows with a text and a label: a sample by hash of the text of about
    ``sample_rows`` at most, or all if there are fewer rows. Copies of a text are one, so that a large group of them cannot
    fill the sample. Counts are summed by language before the driver gets them: a row per language."""
    rows = labelled.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    total = rows.count()
    if total > sample_rows:
        whole = 1 << 50
        rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(whole)) < whole * sample_rows // total)
    rows = rows.distinct().repartition(16)
    schema = "lang string, counts binary"

    def count(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in parts(batch, RUN_BYTES):
                langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + bucket_counts([t for t, x in zip(texts, langs, strict=True) if x == lang])
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    def add(key, pdf):
        import pandas as pd

        return pd.DataFrame({"lang": [key[0]], "counts": [sum(np.frombuffer(x) for x in pdf["counts"]).tobytes()]})

    found = {r["lang"]: np.frombuffer(r["counts"]) for r in rows.mapInArrow(count, schema).groupBy("lang").applyInPandas(add, schema).toLocalIterator()}
    return model_from(found)


def model_from(found: dict[str, np.ndarray]) -> Model:
    languages, n = sorted(found), 1 << BITS
    counts = np.stack([found[x] for x in languages], axis=1) if languages else np.zeros((2 * n + len(SCRIPTS), 0))

    def likelihood(c: np.ndarray) -> np.ndarray:
        share = np.log((c + 0.2) / (c.sum(axis=0) + 0.2 * n))
        return (SCALE * (share - share.max(axis=1, keepdims=True, initial=-1e9))).astype(np.float32)

    letters = counts[2 * n :]
    writes = letters >= np.maximum(1, 0.005 * letters.sum(axis=0))
    script = np.where(writes | ~writes.any(axis=1, keepdims=True), 0, -FOREIGN).astype(np.float32)
    return Model(languages, likelihood(counts[:n]), likelihood(counts[n : 2 * n]), script)


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each row of scores (word x language) under a cost for each change."""
    n, k = scores.shape
    rows = scores.tolist()
    best, back = rows[0], []
    for row in rows[1:]:
        top = max(range(k), key=best.__getitem__)
        least = best[top] - switch
        back.append([x if best[x] >= least else top for x in range(k)])
        best = [max(b, least) + s for b, s in zip(best, row, strict=True)]
    label = max(range(k), key=best.__getitem__)
    out = np.empty(n, dtype=np.int64)
    out[n - 1] = label
    for t in range(n - 2, -1, -1):
        label = back[t][label]
        out[t] = label
    return out


def label_words(model: Model, w: Words, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The label of each word; where each text's words begin; and the scores (word x language)."""
    letter_scores = model.tri[w.tri]
    letter_scores += model.quad[w.quad]
    scores = np.add.reduceat(letter_scores, w.first_letter, axis=0) + model.script[w.script]
    at = np.flatnonzero(np.append(True, np.diff(w.text) > 0))
    counts = np.diff(np.append(at, len(w.text)))
    overall = np.add.reduceat(scores.astype(np.float64), at, axis=0)
    labels = np.repeat(overall.argmax(axis=1), counts)
    if len(model.languages) > 1:
        rows = np.arange(len(labels))
        own = scores[rows, labels]
        rest = scores.copy()
        rest[rows, labels] = -np.inf
        gain = (rest.max(axis=1) - own).astype(np.float64)
        run = np.cumsum(gain)
        run -= np.repeat(run[at] - gain[at], counts)  # sums within a text
        before = run - gain
        # each text is moved just below the one before it, so that the least value starts anew
        low, high = np.minimum.reduceat(before, at), np.maximum.reduceat(before, at)
        far = np.repeat(np.cumsum(np.append(0.0, high[1:] - low[:-1] + 1)), counts)
        least = np.minimum.accumulate(before - far) + far
        open_texts = np.flatnonzero(np.maximum.reduceat(run - least, at) > switch)
        for t in open_texts.tolist():
            part = slice(at[t], at[t] + counts[t])
            labels[part] = viterbi(scores[part], switch)
    return labels, at, scores


def identify(model: Model, texts: list[str | None], switch: float = SWITCH) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Of each text: language, score, spans (first and last code point, language)."""
    out: list = [(UNKNOWN, 0.0, [])] * len(texts)
    w = words_of(texts)
    if not len(w.text) or not model.languages:
        return out
    labels, at, scores = label_words(model, w, switch)
    k = len(model.languages)
    letters = np.diff(np.append(w.first_letter, len(w.tri)))
    stops = np.append(at[1:], len(w.text))
    share = np.zeros((len(at), k))
    np.add.at(share, (np.repeat(np.arange(len(at)), stops - at), labels), letters)
    main = share.argmax(axis=1)
    part = share[np.arange(len(at)), main] / share.sum(axis=1)
    total = np.add.reduceat(scores.astype(np.float64) * (labels[:, None] == np.repeat(main, stops - at)[:, None]), at, axis=0)
    total -= total[np.arange(len(at)), main][:, None]
    likely = 1 / np.exp(np.minimum(total, 50)).sum(axis=1)
    change = np.append(True, (np.diff(labels) != 0) | (np.diff(w.text) > 0))
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(labels)) - 1
    spans: dict[int, list] = {}
    for t, b, e, x in zip(w.text[first].tolist(), w.begin[first].tolist(), w.end[last].tolist(), labels[first].tolist(), strict=True):
        spans.setdefault(t, []).append((b, e, model.languages[x]))
    for t, m, p, q in zip(w.text[at].tolist(), main.tolist(), part.tolist(), likely.tolist(), strict=True):
        out[t] = (model.languages[m], min(1.0, p * q), spans[t])
    return out


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """The id column, lang_pred, score, spans array<struct<begin, end, lang>>. The model (bounded by its buckets and
    languages) reaches the tasks as a broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
    schema = T.StructType(
        [T.StructField(id_col, id_type(docs, id_col)), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))]
    )

    def work(ids, texts):
        lang, score, spans = zip(*identify(shared.value, texts, switch), strict=True)
        return {id_col: ids, "lang_pred": lang, "score": score, "spans": [[dict(zip(span.names, s, strict=True)) for s in x] for x in spans]}

    return map_steps(narrow(docs, id=id_col, text=text_col), work, schema, RUN_BYTES)


def in_language(docs: DataFrame, model: Model, *, least_score: float, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """The rows of ``docs`` whose language was found with at least this score. All columns go through one pass, so that
    no text is shuffled for the decision."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in parts(batch, RUN_BYTES, at):
                found = identify(shared.value, part.column(at).to_pylist(), switch)
                yield part.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from: a third, by CRC-32 of the id as text."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
