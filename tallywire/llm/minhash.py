"""Near-duplicate documents by an LSH forest.

Each set of word shingles has a min-hash signature, cut into several label sequences, one for each tree. A tree is its
labels in sorted order: rows that share the longest common prefix stand next to each other. A region of depth d is a
run of rows that share their first d labels.

1. Documents with equal sets are a class, known by its smallest id; only class representatives go on.
2. First round: neighbours in the sorted order of some trees. Links are confirmed on the full sets and contracted to
   components, so that a large group of near copies costs what its size is, not its square.
3. Second round: regions in all trees. A row's region starts at ``SHALLOWEST`` labels and is looked at one label deeper
   until it holds at most ``REGION_ROWS`` rows, or rows of one component only: its depth adapts to how crowded the place
   is. All pairs of a region that are of different components are candidates.
4. Exact round: two sets of similarity s share D labels in a tree with probability s^D, whatever else the row meets; that
   its region there is deeper than D happens in a share F of its trees. So a partner is found in a tree with probability
   s^D - F at least. Where no D makes this large enough for all trees to fail with at most ``MISS``, as in the midst of
   many texts made from one form, the row is not settled. Rows not settled are joined on their rarest shingles by a
   prefix filter, which loses no pair at the threshold.

Trees are dealt out by ranges of (labels, id), which splits a region of any size, and gone through in blocks of bounded
size. A region that touches the end of a block may go on elsewhere: it does not count, and its rows look deeper.

Defined cases: null texts and texts without words have no shingles, are linked with nothing and kept; fewer words than
a shingle has make one shingle of them all; rows with one id are one document, linked if any of its texts is; rows without
an id are kept and linked with nothing; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.llm.arrow import STEP_BYTES, id_type, parts
from tallywire.llm.editembed import mix
from tallywire.llm.forest import candidate_pairs, looked_up
from tallywire.llm.graph import components
from tallywire.llm.shared import written
from tallywire.llm.shingles import shingle_sets

TREES, DEPTH = 24, 10
#: Bytes of a tree's labels: four for each of the first two, two for each other.
LABELS = [4, 4] + [2] * (DEPTH - 2)
TREE_BYTES = sum(LABELS)
#: Labels that candidates share at least.
SHALLOWEST = 2
#: Trees of the first round.
FIRST_TREES = 8
#: Rows of a region whose pairs are all candidates; in a larger one the next label is taken in.
REGION_ROWS = 24
#: A row that may miss a partner at the threshold with more than this probability goes to the exact round.
MISS = 1e-6
#: Up to so many ids (long or short, some tens of MB) are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def signatures(sets: list[np.ndarray]) -> list[bytes | None]:
    """The labels of all trees as bytes, big end first; none for an empty set."""
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    out: list[bytes | None] = [None] * len(sets)
    if not len(full):
        return out
    x = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    seeds = mix(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64))
    factor, shift = (seeds[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[1::2] >> np.uint64(32)).astype(np.uint32)
    parts = []
    for h in range(TREES * DEPTH):
        least = np.minimum.reduceat(x * factor[h] + shift[h], at)
        # small values are what minima have in common: spread them before cutting
        label = (mix(least.astype(np.uint64) + (np.uint64(h) << np.uint64(32))) >> np.uint64(32)).astype(">u4")
        parts.append(label.view(np.uint8).reshape(-1, 4)[:, : LABELS[h % DEPTH]])
    rows = np.concatenate(parts, axis=1)
    for i, row in zip(full.tolist(), rows, strict=True):
        out[i] = row.tobytes()
    return out


def set_key(s: np.ndarray) -> bytes | None:
    """128 bits of a set, equal for equal sets."""
    if not len(s):
        return None
    return int(s.sum(dtype=np.uint64)).to_bytes(8, "big") + int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)).to_bytes(8, "big")


def _map_sets(docs: DataFrame, columns, schema: T.StructType, words: int) -> DataFrame:
    """Apply ``columns(ids, sets)`` to the shingle sets of a frame (id, binary text)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in parts(batch, STEP_BYTES):
                found = columns(part.column(0), shingle_sets(part.column(1).to_pylist(), words))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(found, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(run, schema)


def unsettled(found: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Rows (id, component) that may have a partner which no region showed, from the depths of their regions."""
    needed = TREES * (1 - MISS ** (1 / TREES))
    shares = {d: TREES * (percent / 100) ** d for d in range(SHALLOWEST, DEPTH + 1)}
    if shares[SHALLOWEST] < needed:
        return rows.select("id", "component")
    sure = [F.lit(share) - F.count_if((F.col("depth") == 0) | (F.col("depth") > d)) for d, share in shares.items()]
    deep = found.filter("depth is not null").groupBy(F.col("u").alias("id")).agg(F.greatest(*sure).alias("sure")).filter(F.col("sure") < needed)
    return rows.join(deep, "id", "left_semi").select("id", "component")


def rare_shared(rows: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Candidate pairs (u, v) of different components among rows (id, component): all that can be similar.

    Shingles are ordered by how many rows have them. The first shingle that two similar sets share is among the first of
    both: in a set of n of which o must be shared, it has n - o others before it at most. The larger set must share
    ``percent`` of its own size, the smaller one more, as the union has its size at least twice less what is shared.
    """
    schema = T.StructType([texts.schema["id"], T.StructField("key", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    needed = F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows
    made = lambda ids, sets: (ids, [set_key(s) for s in sets], [s.view(np.int64) for s in sets])
    sets = _map_sets(texts.join(needed, "id", "left_semi"), made, schema, words).filter("key is not null")
    # an id may have several texts, each of them a set; repeated ones are one
    sets = sets.groupBy("id", "key").agg(F.first("shingles").alias("shingles")).join(needed, "id")
    each = written(sets.select("id", "key", F.size("shingles").cast("long").alias("n"), "component", F.explode("shingles").alias("shingle")), "shingles")
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows"), F.min("component").alias("least"), F.max("component").alias("most")).filter("rows > 1")
    ranked = each.join(often, "shingle", "left").select("id", "key", "n", "component", "shingle", F.coalesce("rows", F.lit(1)).alias("rows"), (F.col("least") != F.col("most")).alias("met"))
    ranked = ranked.withColumn("at", F.row_number().over(Window.partitionBy("id", "key").orderBy("rows", "shingle")).cast("long") - 1)
    first = written(ranked.filter(F.expr(f"met and at <= n - (({percent} * n + 99) div 100)")).select("shingle", "id", "n", "component", "at"), "rare")
    both, whole = 100 + percent, 2 * percent
    small = first.filter(F.expr(f"at <= n - (({whole} * n + {both - 1}) div {both})"))
    a, b = (x.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "component", "at")]) for x, side in ((small, "a"), (first, "b")))
    order = "component_a <> component_b and n_a <= n_b"
    reach = f"100 * n_a >= {percent} * n_b and {both} * least(n_a - at_a, n_b - at_b) >= {percent} * (n_a + n_b)"
    return a.join(b, "shingle").filter(f"{order} and {reach}").select(F.least("id_a", "id_b").alias("u"), F.greatest("id_a", "id_b").alias("v")).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs of ids whose full shingle sets are similar: 100 * intersection >= percent * union.

    Texts are read again for the ids that occur in pairs: a count decides whether these ids are broadcast.
    """
    needed = written(pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct(), "needed")
    if needed.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    schema = T.StructType([texts.schema["id"], T.StructField("hashes", T.BinaryType())])
    sets = written(_map_sets(texts.join(needed, "id", "left_semi"), lambda ids, found: (ids, [s.tobytes() for s in found]), schema, words), "sets")
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("hashes").alias("b")), "v")
    link = T.StructType([T.StructField("u", pairs.schema["u"].dataType), T.StructField("v", pairs.schema["v"].dataType)])

    def similar(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                shared = int(np.count_nonzero(q[np.minimum(at, len(q) - 1)] == p)) if len(p) else 0
                keep.append(100 * shared >= percent * (len(p) + len(q) - shared) and shared > 0)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(similar, link)


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: the id column, n_shingles, component_id (the smallest id it can reach), kept."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    kind = id_type(docs, id_col)
    schema = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("labels", T.BinaryType())])
    signed = written(_map_sets(texts, lambda ids, sets: (ids, [len(s) for s in sets], [set_key(s) for s in sets], signatures(sets)), schema, words), "signatures")
    classes = written(
        signed.filter(F.col("key").isNotNull() & F.col("id").isNotNull()).groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("labels").alias("labels")), "classes"
    )
    trees = F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("labels", t * TREE_BYTES + 1, TREE_BYTES).alias("labels")) for t in range(TREES)])

    def forest(representatives: DataFrame, count: int) -> DataFrame:
        return representatives.select("id", "n", "component", F.explode(F.slice(trees, 1, count)).alias("x")).select("x.tree", "x.labels", "id", "n", "component")

    tried = written(candidate_pairs(looked_up(forest(classes.withColumn("component", F.col("id")), FIRST_TREES), LABELS, SHALLOWEST, 0, percent)), "pairs")
    first = written(confirmed(tried, texts, words, percent), "links")

    def labelled(found: DataFrame) -> DataFrame:
        return classes.join(found, classes["id"] == found["node"], "left").select("id", "n", "labels", F.coalesce("component", "id").alias("component"))

    def grown(known: DataFrame, more: DataFrame) -> DataFrame:
        """Components after some links more: what is known are stars already."""
        return components(known.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))

    joined = components(first)
    placed = labelled(joined)
    found = written(looked_up(forest(placed, TREES), LABELS, SHALLOWEST, REGION_ROWS, percent), "regions")
    new = written(candidate_pairs(found).join(tried, ["u", "v"], "left_anti"), "pairs")
    joined = written(grown(joined, written(confirmed(new, texts, words, percent), "links")), "components")
    left = written(unsettled(found, labelled(joined), percent), "unsettled")
    if not left.isEmpty():
        far = written(rare_shared(left, texts, words, percent).join(tried.unionByName(new), ["u", "v"], "left_anti"), "pairs")
        joined = written(grown(joined, written(confirmed(far, texts, words, percent), "links")), "components")
    known = classes.select(F.col("key").alias("known"), F.col("id").alias("first")).join(joined, F.col("first") == F.col("node"), "left").select("known", F.coalesce("component", "first").alias("component"))
    out = signed.select("id", "n", "key").join(known, F.col("key") == F.col("known"), "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.withColumn("kept", F.col(f"`{id_col}`").eqNullSafe(F.col("component_id")))


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)


ORACLE_SQL = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, b.b FROM reach r JOIN ways b ON b.a = r.seen
), least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""
