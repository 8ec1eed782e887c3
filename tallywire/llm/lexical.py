"""Ranked lexical search over a tiered index: the postings of highest impact are read first.

A term is a run of ASCII letters, digits and other characters beyond ASCII, A-Z lower-cased. A posting's impact is
``1000000000 tf div (1000 tf + 8 m)`` with ``m = 10 + 90 n N div L``, and counts as often as its term weighs,
``w = floor(1000 ln((2 N + 2) / (2 df + 1)))``. (N documents with terms, L terms, n of them in the document, df documents with
the term, tf times in this one.)

The index is a table of segments: runs of some thousands of documents with, for each tier, posting lists by term.
Tiers are cut by impact (``CUTS``), and beside each tier a segment holds its terms' residual bounds: the highest impact
that a term has in lower tiers. Search goes down the tiers, an item at a time as far as it must:

* a pass reads the columns of the first tiers and adds up what they hold. The k-th best sum so far is a floor for the
  item's results; what a document can gain in lower tiers is at most the weighted residuals of the terms not yet seen in it.
* an item whose floor is above all residuals of every segment is proved: only documents met so far can be among its results.
  Those whose sum and residuals reach the floor are completed from all tiers, exactly.
* other items, and those with fewer than k results, fall through to the next tier. The last one has no residuals and is exact.

Nothing but segments is shuffled or grouped: a pass keeps the k best of each item in a task, and these are merged by item.
Items come in blocks of ``BLOCK_TERMS`` terms, each of which is a pass of its own, so what goes to tasks is bounded. An index
may be made for the terms of given items only: if these are at most ``VOCABULARY`` they go to the tasks, else all terms are indexed.

Defined cases: null texts have no terms; documents without terms are never results; null and repeated ids are documents of their
own, equal scores come by ascending id (nulls first); items of one id are one item, with the terms of all, and items
without terms have no results; texts of any length are read whole, in parts; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.llm.arrow import STEP_BYTES, id_type, parts
from tallywire.llm.shared import written

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Impacts at which tiers end; the last tier takes the rest.
CUTS = (400_000, 150_000)
#: A segment is closed at so many documents or distinct terms in documents.
SEGMENT_DOCS, SEGMENT_POSTINGS = 4096, 1 << 21
#: Bytes of a text that are read at a time.
PART = 1 << 20
#: Terms of items sent to the tasks while indexing; terms of the items of one search pass.
VOCABULARY, BLOCK_TERMS = 1_000_000, 100_000


def term_counts(text: bytes | None) -> Counter:
    """How often each term is in a text."""
    found: Counter = Counter()
    text, at = text or b"", 0
    while at < len(text):
        cut = BREAK.search(text, at + PART)
        stop = cut.start() if cut else len(text)
        found.update(TERM.findall(text[at:stop].lower()))  # bytes: only A-Z change
        at = stop
    return found


def item_terms(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term): the different terms of each item."""
    schema = T.StructType([T.StructField("item", id_type(items, id_col)), T.StructField("term", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, STEP_BYTES):
                ids, terms = [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    found = term_counts(text)
                    ids += [row] * len(found)
                    terms += found
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ids, pa.int64())), pa.array(terms, pa.binary())], schema=arrow)

    rows = items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, schema).distinct()


# ---- the index


class _Segment:
    """Documents of a segment while it grows: ids, numbers of terms, and postings (term, document, tf)."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.names = [], [], {}
        self.terms, self.docs, self.tfs = [], [], []

    def add(self, key: object, found: Counter, only: frozenset | None) -> None:
        names, doc = self.names, len(self.ids)
        kept = found.keys() if only is None else found.keys() & only
        for term in kept:
            self.terms.append(names.setdefault(term, len(names)))
            self.tfs.append(found[term])
        self.docs += [doc] * len(kept)
        self.ids.append(key)
        self.sizes.append(found.total())

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or len(self.terms) >= SEGMENT_POSTINGS

    def row(self) -> dict:
        terms = np.array(self.terms, dtype=np.int64)
        order = np.argsort(terms, kind="stable")
        ends = np.cumsum(np.bincount(terms, minlength=len(self.names)))
        return {
            "ids": self.ids, "sizes": self.sizes, "terms": list(self.names), "ends": ends,
            "docs": np.array(self.docs, dtype=np.int32)[order], "tfs": np.array(self.tfs, dtype=np.int64)[order],
            "n_docs": sum(n > 0 for n in self.sizes), "n_terms": sum(self.sizes),
        }


def _counted(docs: DataFrame, only: frozenset | None, id_col: str, text_col: str) -> DataFrame:
    """Segments with term counts: a row for each run of documents of a task."""
    long, of = T.LongType(), T.ArrayType
    fields = {"ids": of(id_type(docs, id_col)), "sizes": of(long), "terms": of(T.BinaryType()), "ends": of(long), "docs": of(T.IntegerType()), "tfs": of(long), "n_docs": long, "n_terms": long}
    schema = T.StructType([T.StructField(n, t) for n, t in fields.items()])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    told = docs.sparkSession.sparkContext.broadcast(only)

    def out(segment: _Segment) -> pa.RecordBatch:
        row = segment.row()
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, kept = _Segment(), told.value
        for batch in batches:
            for part in parts(batch, STEP_BYTES):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    segment.add(key, term_counts(text), kept)
                    if segment.full():
                        yield out(segment)
                        segment = _Segment()
        if segment.ids:
            yield out(segment)

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(run, schema)


def impacts(tf: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of postings with term counts tf in documents of so many terms."""
    if len(sizes) and 90 * int(sizes.max()) * n_docs >= 1 << 63:
        share = np.array([90 * int(n) * n_docs // n_terms for n in sizes], dtype=np.int64)
    else:
        share = 90 * sizes * n_docs // max(n_terms, 1)
    return 1_000_000_000 * tf // (1000 * tf + 8 * (10 + share))


def _lists(array: pa.Array) -> np.ndarray:
    """The values of a column of lists with one row."""
    return array.flatten().to_numpy(zero_copy_only=False)


def _tier_columns(tier: int) -> list[str]:
    return [f"{name}_{tier}" for name in ("ends", "docs", "impacts", "residual")]


class Index:
    """Segments (ids, terms, and for each tier ends, docs, impacts, residual by term), and the corpus' N and L."""

    def __init__(self, segments: DataFrame, sizes: DataFrame, n_docs: int, n_terms: int, id_type: T.DataType) -> None:
        self.segments, self.sizes, self.n_docs, self.n_terms, self.id_type = segments, sizes, n_docs, n_terms, id_type

    tiers = len(CUTS) + 1


def build_index(docs: DataFrame, *, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all documents: of all their terms, or of those in a table ``terms`` (term), if they are few enough."""
    only = None
    if terms is not None:
        few = [bytes(r.term) for r in terms.select("term").distinct().limit(VOCABULARY + 1).collect()]
        only = frozenset(few) if len(few) <= VOCABULARY else None
    counted = written(_counted(docs, only, id_col, text_col), "counts")
    n_docs, n_terms = counted.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    long, of = T.ArrayType(T.LongType()), T.ArrayType
    fields = [T.StructField("ids", counted.schema["ids"].dataType), T.StructField("terms", of(T.BinaryType()))]
    for tier in range(Index.tiers):
        fields += [T.StructField(n, of(T.IntegerType()) if n.startswith("docs") else long) for n in _tier_columns(tier)]
    schema = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(i).slice(at, 1) for i, n in enumerate(batch.schema.names)}
                ends, where, tfs, sizes = (_lists(row[n]) for n in ("ends", "docs", "tfs", "sizes"))
                impact = impacts(tfs, sizes[where], n_docs, n_terms)
                term = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                made, high = [row["ids"], row["terms"]], None
                for cut in (*CUTS, 0):
                    here = impact >= cut if high is None else (impact >= cut) & (impact < high)
                    below = impact < cut
                    residual = np.zeros(len(ends), dtype=np.int64)
                    np.maximum.at(residual, term[below], impact[below])
                    held = np.cumsum(np.bincount(term[here], minlength=len(ends)))
                    for values in (held, where[here], impact[here], residual):
                        made.append(pa.array([values], arrow.field(len(made)).type))
                    high = cut
                yield pa.RecordBatch.from_arrays(made, schema=arrow)

    segments = counted.select("ids", "terms", "sizes", "ends", "docs", "tfs").mapInArrow(run, schema)
    starts = F.transform("ends", lambda e, i: F.struct(F.get("terms", i).alias("term"), (e - F.coalesce(F.get("ends", i - 1), F.lit(0))).alias("df")))
    return Index(written(segments, "index"), counted.select(F.explode(starts).alias("x")).select("x.term", "x.df"), n_docs, n_terms, id_type(docs, id_col))


# ---- search


def _best(scores: list[int], ids: list, k: int) -> tuple[list[int], list]:
    """The k best of scores with ids: by score, then by id, nulls first."""
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i] is not None, ids[i] if ids[i] is not None else 0))[:k]
    return [scores[i] for i in order], [ids[i] for i in order]


def _highest(sums: np.ndarray, ids: pa.Array, where: np.ndarray, k: int) -> tuple[list[int], list]:
    """Of documents ``where`` with sums, the k best."""
    if len(where) > k:
        least = np.partition(sums[where], len(where) - k)[len(where) - k]
        where = where[sums[where] >= least]  # ties at the end are told apart by id
    return _best(sums[where].tolist(), ids.take(pa.array(where)).to_pylist(), k)


def _pass(index: Index, asked: list[dict], depth: int, k: int, complete: bool) -> DataFrame:
    """One pass over the segments, down to tier ``depth``: the best documents by item, and in rows without a score the highest residual.

    ``asked``: items {at, terms, weights, floor, depth}. With ``complete``, the documents that can reach an item's floor by the
    tiers down to its own depth, with whole scores."""
    reads = index.tiers if complete else depth + 1
    columns = ["ids", "terms"] + [c for tier in range(reads) for c in _tier_columns(tier)]
    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("doc_id", index.id_type), T.StructField("score", T.LongType()), T.StructField("residual", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    told = index.segments.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = told.value
        kept = {item["at"]: ([], [], 0) for item in items}
        names = pa.array(sorted({t for item in items for t in item["terms"]}), pa.binary())
        number = {t: i for i, t in enumerate(names.to_pylist())}
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(i).slice(at, 1) for i, n in enumerate(batch.schema.names)}
                ids, place = row["ids"].flatten(), pc.index_in(names, row["terms"].flatten()).to_pylist()
                tiers = [[_lists(row[c]) for c in _tier_columns(t)] for t in range(reads)]
                for item in items:
                    held = [(place[number[t]], w) for t, w in zip(item["terms"], item["weights"], strict=True)]
                    held = [(p, w) for p, w in held if p is not None]
                    if not held:
                        continue
                    down = item["depth"] if complete else depth
                    sums = np.zeros(len(ids), dtype=np.int64)
                    left = sum(w * int(tiers[down][3][p]) for p, w in held)
                    if complete:
                        reach = np.full(len(ids), left, dtype=np.int64)
                    for tier, (ends, where, impact, _) in enumerate(tiers):
                        for p, w in held:
                            part = slice(ends[p - 1] if p else 0, ends[p])
                            gain = w * impact[part]
                            sums[where[part]] += gain
                            if complete and tier <= down:
                                reach[where[part]] += gain - w * int(tiers[down][3][p])
                    found = np.flatnonzero(reach >= item["floor"] if complete else sums > 0)
                    scores, keys = _highest(sums, ids, found, k)
                    before = kept[item["at"]]
                    kept[item["at"]] = (*_best(before[0] + scores, before[1] + keys, k), max(before[2], left))
        for at, (scores, keys, residual) in kept.items():
            rows = [pa.array([at] * (len(keys) + 1), pa.int64()), pa.array([*keys, None], arrow.field(1).type), pa.array([*scores, None], pa.int64()), pa.array([None] * len(keys) + [residual], pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, schema=arrow)

    return index.segments.select(*columns).mapInArrow(run, schema)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("at").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.filter(F.col("score") > 0).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(asked: DataFrame, n_docs: int) -> Iterator[list[dict]]:
    """Items in blocks with at most BLOCK_TERMS terms, or one item: {at, key, terms, weights}."""
    weight = lambda df: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    block, size = [], 0
    for at, r in enumerate(asked.toLocalIterator()):
        if block and size + len(r.terms) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append({"at": at, "key": r.item, "terms": [bytes(t.term) for t in r.terms], "weights": [weight(t.df) for t in r.terms]})
        size += len(r.terms)
    if block:
        yield block


def search(index: Index, terms: DataFrame, *, k: int = 10, report: Callable[[int, int], None] | None = None) -> DataFrame:
    """(item, rank, doc_id, score): the k best documents of each item of a table (item, term). ``report`` is told how many items each
    tier has proved."""
    spark = terms.sparkSession
    wanted = terms.select("term").distinct()
    df = index.sizes.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    asked = terms.join(df, "term").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "df"))).alias("terms"))
    item_type, results = terms.schema["item"].dataType, []
    for block in _blocks(asked, index.n_docs):
        open_items, proved, last = block, [], index.tiers - 1
        for depth in range(last):
            if not open_items:
                break
            found = written(_pass(index, open_items, depth, k, False), "tier")
            least = _top(found, k).groupBy("at").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
            residual = found.groupBy("at").agg(F.max("residual").alias("residual"))
            # two numbers for each item of the block
            said = {r["at"]: (r["n"], r["floor"], r["residual"]) for r in residual.join(least, "at", "left").collect()}
            shown = lambda at: said.get(at) and said[at][0] == k and said[at][2] < said[at][1]  # noqa: B023,E731
            proved += [item | {"floor": said[item["at"]][1], "depth": depth} for item in open_items if shown(item["at"])]
            open_items = [item for item in open_items if not shown(item["at"])]
            if report:
                report(depth, len(block) - len(open_items))
        passes = [_pass(index, proved, last, k, True)] if proved else []
        if open_items:
            passes.append(_pass(index, open_items, last, k, False))
        keys = spark.createDataFrame([(i["at"], i["key"]) for i in block], T.StructType([T.StructField("at", T.LongType()), T.StructField("item", item_type)]))
        both = passes[0] if len(passes) == 1 else passes[0].unionByName(passes[1])
        results.append(_top(both, k).join(F.broadcast(keys), "at").select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not results:
        fields = [T.StructField("item", item_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", index.id_type), T.StructField("score", T.LongType())]
        return spark.createDataFrame([], T.StructType(fields))
    # a block's results are at most k rows an item: they are written, so that blocks do not pile up in one plan
    whole = results[0] if len(results) == 1 else written(results[0], "results")
    for more in results[1:]:
        whole = whole.unionByName(written(more, "results"))
    return whole


def op11_search(spark, sf_dir: str) -> DataFrame:
    terms = written(item_terms(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")), "terms")
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), terms=terms)
    return search(index, terms).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH found AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), sizes AS (
    SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id
), corpus AS (
    SELECT CAST(count(*) AS BIGINT) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sizes
), postings AS (
    SELECT doc_id, term, count(*) AS tf FROM found GROUP BY ALL
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2.0 * c.all_docs + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w
    FROM postings, corpus c GROUP BY term, c.all_docs
), scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * c.all_docs) // c.all_terms)))) AS BIGINT) AS score
    FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), corpus c GROUP BY ALL
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
