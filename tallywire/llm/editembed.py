"""Document fingerprints by a randomised edit embedding.

All texts share one random table. A walk goes through a text's characters and writes each as often as the table says for
this step and character, so that two texts fall back into step soon after an edit: edit distance becomes Hamming
distance between the written strings. A fingerprint samples positions of the written string, a few bits of each; the
positions suit all lengths, as each is the last of a fixed series that lies within the string (a reservoir sample).
Bands of sampled positions give candidates for near copies, which are verified on whole fingerprints and joined to
classes. A band is a sequence of samples; where many fingerprints share its begin, more of it is looked at. What bands leave
apart is then compared by blocks of samples, which miss no pair.

The walk is kept as the step at which each character begins. It runs over many texts in step, and one by one over
what is left of the longest.

Defined cases: a null text is an empty one, with the empty fingerprint, which is like itself alone; repeated rows and equal
texts have equal fingerprints; documents with equal ids follow in a fixed order of their texts (by hash); a single document is its own
next; an empty table gives an empty result; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import functools
import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.llm.arrow import id_type, narrow
from tallywire.llm.forest import candidate_pairs, looked_up
from tallywire.llm.graph import components
from tallywire.llm.shared import written

#: Positions sampled of a written string, and bits kept of each (as one hexadecimal digit).
SAMPLES = 256
#: Steps after which the random table starts again, and classes that characters are hashed to.
PERIOD, CLASSES = 1 << 12, 64
#: Texts that walk in step at least; below that they walk one by one.
TOGETHER = 48
#: Bands, samples of their labels (the first label, which candidates share, and what a crowded region adds one by one).
BANDS, BAND_WIDTHS = 16, [5] + [1] * 9
#: Of 16 samples more that a band carries, how many a pair has equal to be a candidate. At a likeness of 0.8, 13 are on average.
EQUAL = 8
#: Representatives of a region whose pairs are all candidates.
REGION_ROWS = 24
#: Shares in which the keys of the exact round are made, one after another, so that few of them lie on disk at a time.
SHARES = 4
#: Rows whose keys a task makes at a time.
KEY_ROWS = 1 << 11
#: Up to so many ids are broadcast to mark near copies, some tens of MB; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Characters that a task works on at a time.
STEP_CHARS = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def stays() -> np.ndarray:
    """By step and class: how many steps a walk stays at a character. A shared random bit ends the stay."""
    bits = (mix(np.arange(PERIOD * CLASSES, dtype=np.uint64) + np.uint64(0x5EED)) & np.uint64(1)).astype(bool).reshape(PERIOD, CLASSES)
    out = np.zeros((PERIOD, CLASSES), dtype=np.int64)
    after = np.zeros(CLASSES, dtype=np.int64)
    for _ in range(2):  # twice round, as a stay may run over the end
        for j in range(PERIOD - 1, -1, -1):
            after = out[j] = np.where(bits[j], 1, after + 1)
    return out.ravel()


@functools.cache
def series() -> list[np.ndarray]:
    """Of each sample, rising positions: the last one below a length is uniform below it, whatever the length."""
    out = []
    for b in range(SAMPLES):
        u = (mix(np.arange(400, dtype=np.uint64) + np.uint64(b << 20)) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 1e-12
        at, found = 0, [0]
        for x in u.tolist():
            at = int((at + 1) / x)
            if at > 1 << 33:
                break
            if at > found[-1]:
                found.append(at)
        out.append(np.array(found, dtype=np.int64))
    return out


@functools.cache
def _series_table() -> tuple[np.ndarray, np.ndarray]:
    most = max(map(len, series()))
    table = np.full((SAMPLES, most), 1 << 62, dtype=np.int64)
    for b, s in enumerate(series()):
        table[b, : len(s)] = s
    return table, np.arange(SAMPLES)


def classes(points: np.ndarray) -> np.ndarray:
    return ((points * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.int64)


def walk(kinds: np.ndarray, begins: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps at which characters begin, and at which each text ends; text d starts at step ``first[d]``."""
    table, mask = stays(), PERIOD - 1
    steps = np.empty(len(kinds), dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    base, size, at = begins[order], sizes[order], first[order].copy()
    live = len(order) - np.searchsorted(size[::-1], np.arange(int(size[0]) + 1 if len(size) else 0), side="right")
    i = 0
    while i < len(live) and live[i] >= TOGETHER:
        m = live[i]
        where, now = base[:m] + i, at[:m]
        steps[where] = now
        now += table[(now & mask) * CLASSES + kinds[where]]
        i += 1
    if i < len(live):
        rows = table.reshape(PERIOD, CLASSES).tolist()
        for d in range(live[i]):
            j, out = int(at[d]), []
            for kind in kinds[base[d] + i : base[d] + size[d]].tolist():
                out.append(j)
                j += rows[j & mask][kind]
            steps[base[d] + i : base[d] + size[d]] = out
            at[d] = j
    ends = np.empty_like(at)
    ends[order] = at
    return steps, ends


def sampled(points: np.ndarray, steps: np.ndarray, end: int) -> str:
    """The fingerprint of one text's walk."""
    if not len(points):
        return ""
    table, number = _series_table()
    position = table[number, (table < end).sum(axis=1) - 1]
    chars = points[np.searchsorted(steps, position, side="right") - 1].astype(np.uint64)
    digits = (mix(chars * np.uint64(SAMPLES) + number.astype(np.uint64)) >> np.uint64(60)).astype(np.uint8)
    return (digits[::2] << 4 | digits[1::2]).tobytes().hex()


def fingerprints(texts: list[str | None]) -> list[str]:
    return [f for f, _ in edited_fingerprints(texts, None)]


def edited_fingerprints(texts: list[str | None], heads: list[tuple[int, str]] | None) -> list[tuple[str, str]]:
    """Of each text its fingerprint, and that of the text whose end from a code point on is replaced: ``heads`` holds
    (that code point, replacement). The walk up to there is shared."""
    points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    steps, ends = walk(classes(np.concatenate(points)), begins, sizes, np.zeros(len(points), dtype=np.int64))
    walks = [steps[b : b + n] for b, n in zip(begins, sizes, strict=True)]
    own = [sampled(p, s, int(e)) for p, s, e in zip(points, walks, ends, strict=True)]
    if heads is None:
        return [(f, f) for f in own]
    tails = [np.frombuffer(h.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for _, h in heads]
    first = np.array([int(s[k]) if k < len(s) else int(e) for (k, _), s, e in zip(heads, walks, ends, strict=True)], dtype=np.int64)
    more = np.array([len(t) for t in tails], dtype=np.int64)
    behind = np.concatenate([[0], np.cumsum(more)])[:-1]
    steps, ends = walk(classes(np.concatenate(tails)), behind, more, first)
    out = []
    for d, (k, _) in enumerate(heads):
        joined = np.concatenate([points[d][:k], tails[d]]), np.concatenate([walks[d][:k], steps[behind[d] : behind[d] + more[d]]])
        out.append((own[d], sampled(*joined, int(ends[d]))))
    return out


def likeness(a: str, b: str) -> float:
    """Share of equal samples beyond what chance gives, 0 to 1; the empty fingerprint is like itself alone."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    same = sum(map(str.__eq__, a, b)) / len(a)
    return max(0.0, (same - 1 / 16) / (15 / 16))


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, n_chars, fingerprint."""
    from tallywire.llm.arrow import map_steps

    schema = T.StructType([T.StructField(id_col, id_type(docs, id_col)), T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])
    work = lambda ids, texts: {id_col: ids, "n_chars": [len(t or "") for t in texts], "fingerprint": fingerprints(texts)}
    return map_steps(narrow(docs, id=id_col, text=text_col), work, schema, STEP_CHARS)


def half_bytes(prints: pa.Array) -> np.ndarray:
    """Samples of fingerprints that are not empty, a row for each."""
    whole = np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(len(prints), SAMPLES // 2)
    return np.stack([whole >> 4, whole & 15], axis=2).reshape(len(prints), SAMPLES)


def most_differing(at_least: float) -> int:
    """In how many samples two fingerprints of this likeness may differ."""
    likeness_of = (np.arange(SAMPLES, -1, -1) / SAMPLES - 1 / 16) / (15 / 16)
    return int(np.count_nonzero(likeness_of >= at_least)) - 1


def key_blocks(at_least: float) -> np.ndarray:
    """Where blocks of samples begin, and their end: so many that two fingerprints of this likeness differ in one sample of some
    block at most."""
    return np.linspace(0, SAMPLES, min(SAMPLES, most_differing(at_least) // 2 + 1) + 1).astype(np.int64)


def block_keys(digits: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Of each row, a key for every sample of these blocks: all samples of its block but that one, as a 64-bit sum of hashes. Rows
    that differ in one sample of a block at most share one of its keys."""
    table = mix(np.arange(SAMPLES * 16, dtype=np.uint64) + np.uint64(0xB10C)).reshape(SAMPLES, 16)
    at = np.arange(blocks[0], blocks[-1])
    each = table[at, digits[:, at]]
    return (np.repeat(np.add.reduceat(each, blocks[:-1] - blocks[0], axis=1), np.diff(blocks), axis=1) - each).view(np.int64)


def leaders(links: DataFrame, near: int) -> DataFrame:
    """(node, leader) of the nodes that have a link (u, v, differ) of at most ``near`` samples: the leader's leader, where a leader is the
    node of most such links among a node and its neighbours."""
    close = links.filter(F.col("differ") <= near).select("u", "v")
    both = close.unionByName(close.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    ranks = both.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    offers = both.join(ranks.withColumnRenamed("u", "v"), "v").select("u", F.struct("n", "v").alias("rank")).unionByName(ranks.select("u", F.struct("n", F.col("u").alias("v")).alias("rank")))
    first = written(offers.groupBy("u").agg(F.max("rank").alias("rank")).select(F.col("u").alias("node"), F.col("rank.v").alias("leader")), "leaders")
    return first.join(first.select(F.col("node").alias("leader"), F.col("leader").alias("_leader")), "leader").select("node", F.col("_leader").alias("leader"))


def clustered(members: DataFrame) -> DataFrame:
    """(id, component, cluster, radius, print) of members (id, component, print, cluster), where a cluster is named by one of its
    component's rows: radius tells in how many samples they differ. Rows of a cluster lie together."""
    schema = T.StructType([*[members.schema[c] for c in ("id", "component", "cluster")], T.StructField("radius", T.IntegerType()), members.schema["print"]])

    def measured(batches):
        for batch in batches:
            if batch.num_rows:
                radius = (half_bytes(batch.column("print")) != half_bytes(batch.column("centre"))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*map(batch.column, ("id", "component", "cluster")), pa.array(radius, pa.int32()), batch.column("print")], names=schema.names)

    of = members.join(members.select(F.col("id").alias("cluster"), F.col("print").alias("centre")), "cluster").select("id", "component", "cluster", "print", "centre")
    # a number is said, as few small rows make many keys
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(of.mapInArrow(measured, schema).repartition(parts, "cluster").sortWithinPartitions("cluster"), "clusters")


def centres(clusters: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(component, cluster, reach, p0, p1, ...): of each cluster the fingerprint that names it, as words of 16 samples, and its largest radius; with
    ``parts`` (component, parts) also that."""
    reach = clusters.groupBy("cluster").agg(F.max("radius").alias("reach"))
    own = clusters.select(F.col("id").alias("cluster"), "component", "print").join(reach, "cluster")
    own = own if parts is None else own.join(parts, "component")
    own = own.select(*[c for c in own.columns if c != "print"], "print")
    names = [f"p{i}" for i in range(SAMPLES // 16)]
    schema = T.StructType([*own.schema.fields[:-1], *[T.StructField(n, T.LongType()) for n in names]])

    def words(batches):
        for batch in batches:
            if batch.num_rows:
                of = np.frombuffer(b"".join(batch.column("print").to_pylist()), "<i8").reshape(batch.num_rows, len(names))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(np.ascontiguousarray(w)) for w in of.T]], names=schema.names)

    return written(own.mapInArrow(words, schema), "centres")


def differing(a: str, b: str) -> Column:
    """In how many samples the words of two sides differ; their names end in ``a`` and ``b``."""

    def ones(i: int) -> Column:
        x = F.col(f"p{i}_{a}").bitwiseXOR(F.col(f"p{i}_{b}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111).cast("long")))

    return functools.reduce(Column.__add__, map(ones, range(SAMPLES // 16)))


def sides(rows: DataFrame) -> list[DataFrame]:
    """The rows twice, with names that end in ``_a`` and in ``_b``."""
    return [rows.select(*[F.col(c).alias(f"{c}_{x}") for c in rows.columns]) for x in "ab"]


def within_reach(most: int) -> Column:
    """Of two sides, whether members may differ in ``most`` samples: their centres are no further apart than that and both reaches."""
    return differing("a", "b") <= F.col("reach_a") + F.col("reach_b") + most


def shared_keys(classes: DataFrame, blocks: np.ndarray) -> DataFrame:
    """(key, component) of the keys that members of several components have, of these blocks: their members differ in one sample of a block at
    most. A class has a key once, whatever its members."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("component", classes.schema["component"].dataType)])

    def keyed(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, KEY_ROWS):
                part = batch.slice(begin, KEY_ROWS)
                keys = block_keys(half_bytes(part.column("print")), blocks)
                component = part.column("component").to_numpy()
                of = np.repeat(np.arange(len(keys)), keys.shape[1])
                keys, take = keys.ravel(), np.ones(keys.size, dtype=bool)
                # rows of a class follow each other: of their equal keys one is left
                same = component[1:] == component[:-1]
                shared = np.flatnonzero((np.append(False, same) | np.append(same, False))[of])
                shared = shared[np.lexsort((component[of[shared]], keys[shared]))]
                k, c = keys[shared], component[of[shared]]
                take[shared[1:][(k[1:] == k[:-1]) & (c[1:] == c[:-1])]] = False
                yield pa.RecordBatch.from_arrays([pa.array(keys[take]), pa.array(component[of[take]])], names=schema.names)

    keys = classes.select("print", "component").mapInArrow(keyed, schema)
    mixed = keys.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    mixed = written(mixed, "keys")
    return written(keys.join(F.broadcast(mixed) if mixed.count() <= BROADCAST_IDS else mixed, "key", "left_semi"), "met")


def close_classes(met: DataFrame, middles: DataFrame, most: int) -> DataFrame:
    """Pairs (few, many) of components within reach that share a key (key, component), the one with fewer clusters first. ``middles`` has
    the centre of each and its number of clusters, ``parts``."""
    a, b = sides(met.join(middles, "component"))
    pairs = a.join(b, (F.col("key_a") == F.col("key_b")) & (F.col("component_a") < F.col("component_b")) & within_reach(most))
    fewer = F.col("parts_a") <= F.col("parts_b")
    return pairs.select(F.when(fewer, F.col("component_a")).otherwise(F.col("component_b")).alias("few"), F.when(fewer, F.col("component_b")).otherwise(F.col("component_a")).alias("many")).distinct()


def members_in_reach(pairs: DataFrame, clusters: DataFrame, middles: DataFrame, most: int) -> DataFrame:
    """Pairs (u, v, print_u, print_v, component_u, component_v) of members that may differ in ``most`` samples, of pairs (few, many) of
    components: clusters within reach, and of them the members that their own radii do not rule out."""
    a, b = sides(middles)
    near = pairs.join(a, F.col("few") == F.col("component_a")).join(b, (F.col("many") == F.col("component_b")) & within_reach(most))
    near = written(near.select("few", "many", "cluster_a", "cluster_b", differing("a", "b").alias("apart"), "reach_b"), "pairs")
    a, b = sides(clusters.select("cluster", "id", "radius", "print"))
    near = near.join(a, "cluster_a").filter(F.col("apart") <= F.col("radius_a") + F.col("reach_b") + most)
    near = near.join(b, "cluster_b").filter(F.col("apart") <= F.col("radius_a") + F.col("radius_b") + most)
    names = {"id_a": "u", "id_b": "v", "print_a": "print_u", "print_b": "print_v", "few": "component_u", "many": "component_v"}
    return near.select(*[F.col(old).alias(new) for old, new in names.items()])


def near_classes(prints: DataFrame, *, id_col: str = "doc_id", print_col: str = "fingerprint", at_least: float = 0.8) -> DataFrame:
    """Near copies among fingerprints (binary): (id, print, near_id) of every row that has a smaller id in its class.

    Fingerprints of likeness ``at_least`` are linked; a class is what links join, known by its smallest id. Equal
    fingerprints are one representative, so that copies cost nothing; it has a number of its own, so that unlike fingerprints of
    one id stay apart. Representatives are sorted by the samples of each
    band. A first round compares neighbours and contracts what is linked; a second one compares, of different
    components, all pairs of a region: a run that shares the first five samples, or as many more as it
    takes to be of ``REGION_ROWS`` rows at most. Null and empty fingerprints and rows without an id are in no class.

    Both rounds may miss a link, where regions are deep or by the 16 samples more that bands carry to leave out what is alike by chance.
    A third round misses none: two fingerprints of likeness 0.8 differ in 48 samples at most, so of 25 blocks of samples there
    is one in which they differ once at most, and they share the key of the block without that sample. All representatives
    have all their keys. So that classes are not compared member by member, a class has a key once, and classes that share one meet
    by a centre each; by the triangle inequality they have no link if their centres are further apart than a link and both their
    reaches. The same is asked of clusters of the classes that are left, and of members of the clusters that are left; what
    remains is verified.
    """
    frame = narrow(prints, id=id_col, print=print_col).filter(F.col("id").isNotNull() & (F.octet_length("print") > 0))
    # numbers are fixed once the table is written
    reps = written(frame.groupBy("print").agg(F.min("id").alias("least")).withColumn("id", F.monotonically_increasing_id()), "prints")
    order = mix(np.arange(BANDS * SAMPLES, dtype=np.uint64) + np.uint64(0xBA9D)).reshape(BANDS, SAMPLES).argsort(axis=1)
    width, kind, differ_most = sum(BAND_WIDTHS), reps.schema["id"], most_differing(at_least)
    rows = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("labels", T.BinaryType()), T.StructField("id", kind.dataType), T.StructField("n", T.LongType()), T.StructField("component", kind.dataType)])

    def banded(batches):
        for batch in batches:
            size = batch.num_rows
            digits = half_bytes(batch.column("print"))
            for band, picks in enumerate(order):
                more = digits[:, picks[width : width + 16]]
                labels = np.hstack([digits[:, picks[:width]], more[:, ::2] << 4 | more[:, 1::2]])
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(labels.shape[1]), size, [None, pa.py_buffer(labels.tobytes())])
                columns = [pa.array(np.full(size, band, dtype=np.int32)), packed.cast(pa.binary()), batch.column("id"), pa.array(np.ones(size, dtype=np.int64)), batch.column("component")]
                yield pa.RecordBatch.from_arrays(columns, names=rows.names)

    def candidates(component: DataFrame, most: int) -> DataFrame:
        return candidate_pairs(looked_up(component.mapInArrow(banded, rows), BAND_WIDTHS, 1, most, 0, EQUAL, depths=False))

    def verified(pairs: DataFrame) -> DataFrame:
        kept = ["u", "v", "component_u", "component_v"]
        link = T.StructType([*[T.StructField(c, pairs.schema[c].dataType) for c in kept], T.StructField("differ", T.IntegerType())])

        def like(batches):
            for batch in batches:
                if batch.num_rows:
                    differ = (half_bytes(batch.column("print_u")) != half_bytes(batch.column("print_v"))).sum(axis=1)
                    found = pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(differ, pa.int32())], names=link.names)
                    yield found.filter(pa.array(differ <= differ_most))

        return written(pairs.select(*kept, "print_u", "print_v").mapInArrow(like, link), "links")

    def both_ends(pairs: DataFrame, rows: DataFrame) -> DataFrame:
        a, b = (rows.select(F.col("id").alias(x), F.col("print").alias(f"print_{x}"), F.col("component").alias(f"component_{x}")) for x in "uv")
        return pairs.join(a, "u").join(b, "v")

    def grouped(rows: DataFrame, links: DataFrame) -> DataFrame:
        """The rows after these links between their components, which alone are nodes: members move with them."""
        moved = components(links.select(F.col("component_u").alias("u"), F.col("component_v").alias("v"))).select(F.col("node").alias("component"), F.col("component").alias("_to"))
        return written(rows.join(moved, "component", "left").select("print", "least", "id", F.coalesce("_to", "component").alias("component")), "members")

    alone = reps.withColumn("component", F.col("id"))
    tried = written(candidates(alone, 0), "pairs")
    tight = verified(both_ends(tried, alone))
    placed = grouped(alone, tight)
    new = written(candidates(placed, REGION_ROWS).join(tried, ["u", "v"], "left_anti"), "pairs")
    more = verified(both_ends(new, placed))
    members = grouped(placed, more)
    blocks = key_blocks(at_least)
    cuts = np.linspace(0, len(blocks) - 1, min(SHARES, len(blocks) - 1) + 1).astype(int).tolist()
    lead = leaders(tight.unionByName(more), 2 * differ_most // 3)
    clusters = clustered(members.join(lead, members["id"] == lead["node"], "left").select("id", "component", "print", F.coalesce("leader", "id").alias("cluster")))
    sizes = clusters.groupBy("component", "cluster").agg(F.count(F.lit(1)).alias("n"))
    centre = written(sizes.groupBy("component").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("cluster"), F.count(F.lit(1)).alias("parts")), "centres")
    classes = clustered(members.join(centre, "component").select("id", "component", "print", "cluster"))
    middles = centres(classes, centre.select("component", "parts")).drop("cluster")
    met = functools.reduce(DataFrame.unionByName, [shared_keys(classes, blocks[i : j + 1]) for i, j in zip(cuts, cuts[1:], strict=False)])
    close = written(close_classes(met, middles, differ_most), "pairs")
    far = verified(members_in_reach(close, clusters, centres(clusters), differ_most))
    if not far.isEmpty():
        members = grouped(members, far)
    smallest = members.groupBy("component").agg(F.min("least").alias("near_id"))
    classes_ = members.join(smallest, "component").select("print", "near_id")
    return frame.join(classes_, "print").filter("id <> near_id").select(F.col("id").alias(id_col), F.col("print").alias(print_col), "near_id").distinct()


_RESULT = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compare(rows: list[tuple[object, str, str]], next_prints: list[str] | None) -> list[tuple]:
    """Result rows for (id, text, next text). The next fingerprint is the following row's, or given."""
    heads = []
    for _, text, after in rows:
        cut = len(text) // 4
        heads.append((len(text) - cut, after[:cut]))
    both = edited_fingerprints([r[1] for r in rows], heads)
    out = []
    for i, ((key, text, _), (keep, head), (own, edited)) in enumerate(zip(rows, heads, both, strict=True)):
        after = next_prints[i] if next_prints else both[i + 1][0] if i + 1 < len(both) else None
        sha = hashlib.sha256((text[:keep] + head).encode("utf-8", "surrogatepass")).digest()
        out.append((key, len(text), sha, bytes.fromhex(own), bytes.fromhex(edited), likeness(own, edited), None if after is None else likeness(own, after)))
    return out


def edited_and_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", near: bool = False) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likeness, in order of ids; with ``near`` also near_id,
    the smallest id of the document's class of near copies (see ``near_classes``), null for texts without characters.

    The edited text has its last quarter replaced by the begin of the next document. Documents are dealt out by ranges of
    ids, once; each task goes through its range in order. The last of a range meets the first of the next one in a
    second, small step with two rows for each range, whose texts lie with the other results in the shared folder.
    """
    frame = narrow(docs, id=id_col, text=text_col)
    kind = id_type(docs, id_col)
    fields = [T.StructField("id", kind), T.StructField("n_chars", T.LongType())]
    fields += [T.StructField(c, T.BinaryType()) for c in _RESULT[2:5]] + [T.StructField(c, T.DoubleType()) for c in _RESULT[5:]]
    edges = [T.StructField("part", T.LongType()), T.StructField("edge", T.StringType()), T.StructField("text", T.StringType())]
    schema = T.StructType(fields + edges)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, result_arrow = to_arrow_schema(schema), to_arrow_schema(T.StructType(fields))

    def table(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    def in_order(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[tuple[object, str]] = []
        chars, begun = 0, False

        def flush() -> pa.RecordBatch | None:
            """Results of all held rows but the last."""
            nonlocal held, chars
            rows = [(a, x, y) for (a, x), (_, y) in zip(held, held[1:], strict=False)]
            last = fingerprints([held[-1][1]])[0]
            done = _compare(rows, None) if rows else []
            if done:
                done[-1] = done[-1][:6] + (likeness(done[-1][3].hex(), last),)
            held, chars = held[-1:], len(held[-1][1])
            return table([r + (part, None, None) for r in done], arrow) if done else None

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                if not begun:
                    begun = True
                    yield table([(key,) + (None,) * 6 + (part, "first", text)], arrow)
                held.append((key, text))
                chars += len(text)
                if chars > STEP_CHARS and len(held) > 1:
                    out = flush()
                    if out is not None:
                        yield out
        if held:
            if (out := flush()) is not None:
                yield out
            yield table([(held[0][0],) + (None,) * 6 + (part, "last", held[0][1])], arrow)

    # texts split a large group of rows without an id, or of one
    ordered = frame.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    made = written(ordered.mapInArrow(in_order, schema), "fingerprints")
    firsts = made.filter(F.col("edge") == "first").select("part", F.col("text").alias("next_text"))
    # a row for each range of ids: its followers come from a window over their numbers alone
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = firsts.select("part").select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(w)).alias("next_part"))
    lasts = made.filter(F.col("edge") == "last").select("part", "id", "text")
    pairs = lasts.join(follows, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("id", "text", "next_text")

    def at_edges(batches):
        for batch in batches:
            for key, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield table(_compare([(key, text, after)], fingerprints([after])), result_arrow)

    done = made.filter(F.col("edge").isNull()).select(*_RESULT)
    done = done.unionByName(pairs.mapInArrow(at_edges, T.StructType(fields)))
    text_of = lambda c: F.lower(F.hex(c)).alias(c)
    if near:
        # an id may have several texts: the fingerprint, as a hash, tells them apart
        which = F.xxhash64("fingerprint").alias("_print")
        copies = written(near_classes(done.select("id", "fingerprint"), id_col="id").select("id", which, "near_id"), "near")
        copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
        done = done.withColumn("_print", which).join(copies, ["id", "_print"], "left").drop("_print").withColumn("near_id", F.coalesce("near_id", F.when(F.octet_length("fingerprint") > 0, F.col("id"))))
    shown = [F.col("id").alias(id_col), "n_chars", *map(text_of, _RESULT[2:5]), *_RESULT[5:], *(["near_id"] if near else [])]
    return done.select(*shown)


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_and_next(spark.read.parquet(f"{sf_dir}/documents.parquet"), near=True)
