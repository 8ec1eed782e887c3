"""Line deduplication by a segment-partition edit join, in Spark expressions only.

A line is compared without the blanks around it. Two line texts are linked if both are long enough and their edit distance
is at most the threshold. Of lines that are equal, from a length of their own on, or linked, an occurrence goes if an earlier one (by id, then line
number) has the same or a linked text; the rest of the document stays as it is.

1. Lines of one length fall into threshold + 1 segments, so that linked lines share a segment. Each line emits a hash
   of each of its segments, and of the substrings that a segment of a line up to ``threshold`` shorter could match, at
   the few places where it could stand (multi-match-aware windows). One aggregate by hash finds the hashes of more
   than one text; a hash of two texts is a candidate pair there and then.
2. Hashes of more texts are joined with themselves, on sketches of characters and of character pairs: an edit changes
   few bits of these, so that only pairs within reach of the threshold come out of that join, each of them once. Where a
   hash has many texts, as template lines do, the sketch of pairs is cut to bands, more of them than edits within the
   threshold can touch, and the band is part of the join key: two linked lines have an equal band.
3. Candidates are verified by a banded bit-parallel edit distance over their code points.
4. Decisions are joined back by line hash, gathered for each document, and applied.

Line texts travel only for candidates, and for the few others that pass a sieve where candidates are too many to be broadcast;
before that there are hashes. Two 64-bit hashes of different seeds stand for a
text wherever texts are told apart. The first alone serves to find candidates: there, two linked lines are lost if they
are also equal in 64 bits.

Defined cases: a null text stays null and has no lines; an empty text has one empty line; short lines are never linked, and
blank ones never dropped; repeated rows (one id and text) are one occurrence, so both stay or lose the same lines; rows without an id come
first; an empty table gives an empty result; extra columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywire.llm.shared import written

THRESHOLD = 2
#: Code points of the shortest line that is linked: on shorter ones two edits are another line.
MIN_CHARS = 24
#: Different texts of a hash from which on the join is keyed by bands of their sketches.
CROWD = 256
#: What a text holds that is more than blanks and line ends.
NOT_BLANK = r"\S"
#: Up to so many hashes are broadcast, a few tens of MB; more are joined by a shuffle.
BROADCAST_HASHES = 1_000_000
#: Words of 64 bits that more hashes are folded to, to leave out most rows before such a shuffle.
SIEVE = 1 << 20


def _first_hash(line: Column) -> Column:
    return F.xxhash64(line)


def _second_hash(line: Column) -> Column:
    return F.xxhash64(F.lit(0x5EED), line)


def segment_places(threshold: int) -> list[tuple[int, int, int]]:
    """(shorter by, segment, shift) of all substrings that a line emits; shift is from the segment's begin."""
    out = []
    for less in range(threshold + 1):
        for i in range(1, threshold + 2):
            low, high = max(1 - i, less - (threshold + 1 - i)), min(i - 1, less + (threshold + 1 - i))
            out += [(less, i, shift) for shift in range(low, high + 1)]
    return out


def segment_entries(lines: DataFrame, threshold: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(h, carried columns, key): hashes of the substrings of each line (h, line) that can match a segment."""
    parts = threshold + 1
    places = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("less", "i", "shift"), place, strict=True)]) for place in segment_places(threshold)])
    # four bytes for each code point: a substring is then found without counting through the line
    rows = lines.select("h", *carry, F.encode("line", "UTF-32").alias("points")).withColumn("size", F.expr("coalesce(cast(octet_length(points) div 4 as int), 0)"))
    rows = rows.select("h", *carry, "points", "size", F.explode(places).alias("x")).select("h", *carry, "points", "size", "x.*")
    length = F.col("size") - F.col("less")
    base, longer = F.expr(f"(size - less) div {parts}").cast("int"), length % parts
    # the last ``longer`` segments have one code point more
    begin = base * (F.col("i") - 1) + F.greatest(F.lit(0), longer - (parts + 1 - F.col("i"))) + F.col("shift")
    width = base + F.when(F.col("i") > parts - longer, 1).otherwise(0)
    placed = rows.select("h", *carry, "points", "i", "size", length.alias("length"), begin.alias("begin"), width.alias("width")).filter("begin >= 0 and begin + width <= size")
    return placed.select("h", *carry, F.xxhash64("length", "i", F.substring(F.col("points"), 4 * F.col("begin") + 1, 4 * F.col("width"))).alias("key"))


def sketches(line: Column) -> Column:
    """struct<n, one, two>: length, and 64 parities each of a line's characters and of its character pairs."""

    def parities(chars: Column) -> Column:
        bit = lambda *x: F.call_function("shiftleft", F.lit(1).cast("long"), F.hash(*x).bitwiseAND(63))
        zero, last = F.lit(0).cast("long"), F.size(chars) - 1
        one = F.aggregate(chars, zero, lambda a, c: a.bitwiseXOR(bit(c)))
        two = F.when(last > 0, F.aggregate(F.sequence(F.lit(0), last - 1), zero, lambda a, i: a.bitwiseXOR(bit(F.get(chars, i), F.get(chars, i + 1))))).otherwise(zero)
        return F.struct(F.size(chars).alias("n"), one.alias("one"), two.alias("two"))

    return _let(F.split(line, ""), parities)


def bands(sketch: Column, threshold: int) -> Column:
    """The parities of pairs in bands: one more of them than bits differ between linked lines, so that one is equal."""
    count = 4 * threshold + 1
    ends = [64 * i // count for i in range(count + 1)]
    cut = lambda a, b: F.shiftrightunsigned(sketch["two"], a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
    return F.array(*[cut(a, b) for a, b in zip(ends, ends[1:], strict=False)])


def within_reach(a: Column, b: Column, threshold: int) -> Column:
    """Whether lines with these sketches can be linked. A substitution changes two characters and four pairs at most,
    an insertion or deletion one and three; a difference in length takes as many of the latter."""
    less = F.abs(a["n"] - b["n"])
    ones = F.bit_count(a["one"].bitwiseXOR(b["one"])) <= 2 * threshold - less
    return (less <= threshold) & ones & (F.bit_count(a["two"].bitwiseXOR(b["two"])) <= 4 * threshold - less)


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """The edit distance of two texts if it is at most the threshold, else a larger number.

    A column of the distance table is kept as vertical differences in a band of ``2 * threshold + 1`` bits around the
    diagonal; bit i stands for the row ``column - threshold + i``. The distance is followed down the band's lower edge
    until that meets the last row, and then along this row.
    """
    k = threshold

    def inner(x: Column) -> Column:
        # what both begin or end with costs no edit
        n = F.least(F.length(x["a"]), F.length(x["b"]))
        return _let(F.struct(x["a"].alias("a"), x["b"].alias("b"), _common(x["a"], x["b"], n, True).alias("head"), n.alias("n")), tail)

    def tail(x: Column) -> Column:
        cut = lambda s: F.substring(s, x["head"] + 1, F.length(s))
        return _let(F.struct(cut(x["a"]).alias("a"), cut(x["b"]).alias("b")), end)

    def end(x: Column) -> Column:
        n = F.least(F.length(x["a"]), F.length(x["b"]))
        return _let(F.struct(x["a"].alias("a"), x["b"].alias("b"), _common(x["a"], x["b"], n, False).alias("same")), rest)

    def rest(x: Column) -> Column:
        keep = lambda s: F.substring(s, F.lit(1), F.length(s) - x["same"])
        # characters and lengths are taken once, not at every column
        ready = lambda p, t: F.struct(F.split(p, "").alias("p"), F.split(t, "").alias("t"), F.length(p).alias("m"), F.length(t).alias("n"))
        either = F.greatest(F.length(x["a"]), F.length(x["b"])) - x["same"]
        empty = F.least(F.length(x["a"]), F.length(x["b"])) <= x["same"]
        return F.when(empty, either.cast("long")).otherwise(_let(ready(keep(x["a"]), keep(x["b"])), lambda y: _walk(y["p"], y["t"], y["m"], y["n"], k)))

    return F.when(F.abs(F.length(a) - F.length(b)) <= k, _let(F.struct(a.alias("a"), b.alias("b")), inner)).otherwise(F.greatest(F.length(a), F.length(b)).cast("long"))


def _common(a: Column, b: Column, n: Column, left: bool) -> Column:
    """Characters that two texts have in common at the left or right end, n at most: found by halving."""
    part = (lambda s, size: F.substring(s, F.lit(1), size)) if left else (lambda s, size: F.substring(s, F.length(s) - size + 1, size))
    powers = F.transform(F.sequence(F.lit(0), F.length(F.bin(n))), lambda i: F.call_function("shiftright", F.call_function("shiftleft", F.lit(1), F.length(F.bin(n))), i))
    return F.aggregate(powers, F.lit(0), lambda got, step: F.when((got + step <= n) & (part(a, got + step) == part(b, got + step)), got + step).otherwise(got))


def _walk(p: Column, t: Column, m: Column, n: Column, k: int) -> Column:
    width = 2 * k + 1
    mask = (1 << width) - 1
    long = lambda x: F.lit(x).cast("long")
    bits = lambda x: x.bitwiseAND(long(mask))

    def column(state: Column, j: Column) -> Column:
        char = F.get(t, j - 1)
        equal = long(0)
        for i in range(width):
            row = j - k + i  # from 1 on
            here = F.when((row >= 1) & (row <= m), F.get(p, row - 1) == char).otherwise(False)
            equal = equal + F.when(here, long(1 << i)).otherwise(long(0))
        vp, vn = state["vp"], state["vn"]
        d0 = bits((equal.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(equal).bitwiseOR(vn))
        return F.struct(vp.alias("vp"), vn.alias("vn"), state["distance"].alias("distance"), d0.alias("d0"), j.alias("j"))

    def finish(s: Column) -> Column:
        vp, vn, d0, j = s["vp"], s["vn"], s["d0"], s["j"]
        hp = bits(vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))))
        hn = d0.bitwiseAND(vp)
        down = F.shiftright(d0, 1)
        bit = lambda x, i: F.shiftright(x, i) if isinstance(i, int) else F.call_function("shiftright", x, i)
        one = lambda x: x.bitwiseAND(long(1))
        edge = long(1) - one(bit(d0, 2 * k))
        last = F.greatest(F.lit(0), m - j + k)
        along = one(bit(hp, last)) - one(bit(hn, last))
        distance = s["distance"] + F.when(j + k <= m, edge).otherwise(along)
        return F.struct(
            bits(hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)))).alias("vp"),
            hp.bitwiseAND(down).alias("vn"),
            distance.alias("distance"),
            long(0).alias("d0"),
            j.alias("j"),
        )

    # rows above the table's first have no difference; below it each adds one
    start = F.struct(long(mask & ~((1 << k) - 1)).alias("vp"), long(0).alias("vn"), F.least(m, F.lit(k)).cast("long").alias("distance"), long(0).alias("d0"), F.lit(0).alias("j"))
    return F.aggregate(F.sequence(F.lit(1), n), start, lambda s, j: _let(column(s, j), finish))["distance"]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, doc, line_no, line, h, g) of every line long enough and not blank; doc stands for the document's text."""
    text = F.col(f"`{text_col}`")
    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("doc"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "raw"))
    out = out.select("id", "doc", "line_no", F.trim("raw").alias("line")).filter((F.length("line") >= min_chars) & (F.btrim("line", F.lit(" \t\n\x0b\f\r")) != ""))
    return out.withColumn("h", _first_hash(F.col("line"))).withColumn("g", _second_hash(F.col("line")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_HASHES else df


def _sifted(rows: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose columns ``on`` are among those asked for, with a few others. Asked ones set two bits each in words of 64 bits, which are
    broadcast and never more than ``SIEVE``, however many are asked for."""
    x = F.xxhash64(*on)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, at).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    word, bits = F.pmod(x, F.lit(SIEVE)).cast("long").alias("_word"), bit(40).bitwiseOR(bit(46)).alias("_bits")
    sieve = asked.select(word, bits).groupBy("_word").agg(F.bit_or("_bits").alias("_all"))
    met = rows.select("*", word, bits).join(F.broadcast(sieve), "_word")
    return met.filter(F.col("_bits").bitwiseAND(F.col("_all")) == F.col("_bits")).select(*rows.columns)


def linked_lines(docs: DataFrame, *, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of different line texts within the threshold: (h, g, other, other_g, distance), both ways round."""
    lines = _lines(docs, id_col, text_col, min_chars)
    entries = segment_entries(lines, threshold)
    shared = written(
        entries.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count(F.lit(1)).alias("n")).filter("a <> b"),
        "segments",
    )
    twos = shared.filter("n = 2").select("a", "b").distinct()
    # one more pass over the lines finds the members of crowded hashes, and the texts of all candidates: a text of a pair
    # is asked for by its own hash, as if that were one more segment
    asked = shared.filter("n > 2").select("key", F.lit(True).alias("crowd"))
    asked = asked.unionByName(twos.select(F.explode(F.array("a", "b")).alias("key"), F.lit(False).alias("crowd")).distinct())
    asked, on = written(asked, "asked"), ["key", "crowd"]
    few = asked.count() <= BROADCAST_HASHES
    whole = lines.select("h", "g", "line", F.col("h").alias("key"), F.lit(False).alias("crowd"))
    pieces = segment_entries(lines, threshold, ("g", "line")).withColumn("crowd", F.lit(True))
    # each line stands there a dozen times with its text, so that no shuffle may take them all
    found = pieces.unionByName(whole)
    found = found.join(F.broadcast(asked), on, "left_semi") if few else _sifted(found, asked, on)
    found = found.groupBy("h", "g", "crowd", "key").agg(F.first("line").alias("line"))
    found = written(found if few else found.join(asked, on, "left_semi"), "members")
    texts = found.groupBy("h", "g").agg(F.first("line").alias("line"))
    texts = written(texts.select(F.struct("h", "g").alias("x"), "h", "line", sketches(F.col("line")).alias("sketch")), "texts")
    a, b = (texts.select(*[F.col(c).alias(f"{c}_{s}") for c in texts.columns]) for s in "ab")
    near = within_reach(F.col("sketch_a"), F.col("sketch_b"), threshold) & (F.col("x_a") < F.col("x_b"))
    # ``a`` is the smaller first hash of the two, so the pair comes in the order of x
    pairs = twos.join(a, F.col("a") == F.col("h_a")).join(b, (F.col("b") == F.col("h_b")) & near).select("x_a", "x_b", "line_a", "line_b")
    # a line has few keys, one for each place of a segment at most; a pair comes out at the least key that both share
    crowded = found.filter("crowd").select(F.struct("h", "g").alias("x"), "key")
    large = _small(written(crowded.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") > crowd).select("key", F.lit(True).alias("large")), "crowds"))
    held = crowded.groupBy("x").agg(F.collect_set("key").alias("keys")).join(texts.select("x", "sketch"), "x")
    held = held.select("x", "sketch", "keys", F.explode("keys").alias("key")).join(large, "key", "left")
    held = held.withColumn("bands", F.when(F.col("large"), bands(F.col("sketch"), threshold)).otherwise(F.array(F.lit(0).cast("long"))))
    held = held.select("x", "sketch", "keys", "key", "bands", F.posexplode("bands").alias("band", "bits"))
    left, right = (held.select("key", "band", "bits", *[F.col(c).alias(f"{c}_{s}") for c in ("x", "sketch", "keys", "bands")]) for s in "ab")
    first_key = F.array_min(F.array_intersect("keys_a", "keys_b")) == left["key"]
    first_band = F.array_position(F.zip_with("bands_a", "bands_b", lambda p, q: p == q), True) == left["band"] + 1
    here = (left["key"] == right["key"]) & (left["band"] == right["band"]) & (left["bits"] == right["bits"]) & (F.col("x_a") < F.col("x_b"))
    reach = within_reach(F.col("sketch_a"), F.col("sketch_b"), threshold)
    close = left.join(right, here & reach & first_key & first_band).select("x_a", "x_b")
    pairs = pairs.unionByName(close.join(a.select("x_a", "line_a"), "x_a").join(b.select("x_b", "line_b"), "x_b"))
    checked = pairs.distinct().repartition("x_a").select("x_a", "x_b", banded_distance(F.col("line_a"), F.col("line_b"), threshold).alias("distance"))
    links = written(checked.filter(F.col("distance") <= threshold).groupBy("x_a", "x_b").agg(F.min("distance").alias("distance")), "links")
    ways = links.select("x_a", "x_b", "distance").unionByName(links.select(F.col("x_b").alias("x_a"), F.col("x_a").alias("x_b"), "distance"))
    return ways.select(F.col("x_a.h").alias("h"), F.col("x_a.g").alias("g"), F.col("x_b.h").alias("other"), F.col("x_b.g").alias("other_g"), "distance")


def dedup_lines(
    docs: DataFrame, *, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, min_equal: int = 1, id_col: str = "doc_id", text_col: str = "text", prefix: str = ""
) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and three columns more, which replace any of these names,
    with ``prefix`` before them: n_lines, dropped_lines (null texts: 0) and line_links (line texts linked to its lines,
    counted for each line).

    Equal lines go from ``min_equal`` code points on, unless they are blank, and linked ones from ``min_chars``."""
    links = linked_lines(docs, threshold=threshold, min_chars=min_chars, id_col=id_col, text_col=text_col)
    lines = _lines(docs, id_col, text_col, min(min_equal, min_chars))
    place = F.struct("id", "line_no")
    firsts = written(lines.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")), "firsts")
    of_other = firsts.select(F.col("h").alias("other"), F.col("g").alias("other_g"), F.col("first").alias("linked_first"))
    before = links.join(of_other, ["other", "other_g"]).groupBy("h", "g").agg(F.min("linked_first").alias("linked_first"), F.count(F.lit(1)).alias("links"))
    ruled = firsts.join(before, ["h", "g"], "left").filter((F.col("first") != F.col("last")) | F.col("links").isNotNull())
    ruled = _small(written(ruled.select("h", "g", F.least("first", "linked_first").alias("earliest"), F.coalesce("links", F.lit(0)).alias("links")), "rules"))
    hit = lines.select("id", "doc", "line_no", "h", "g").join(ruled, ["h", "g"]).withColumn("drop", place > F.col("earliest"))
    per_doc = hit.groupBy(F.col("id").alias("_id"), F.col("doc").alias("_doc")).agg(
        F.collect_set(F.when(F.col("drop"), F.col("line_no"))).alias("_drop"), F.sum("links").alias("_links")
    )
    text = F.col(f"`{text_col}`")
    # the side of decisions is hashed, so that the texts need not be sorted
    joined = docs.join(per_doc.hint("shuffle_hash"), F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_doc")), "left")
    # ``docs`` may hold columns of any names, so what is made is computed beside them in one step
    drop, links_of = per_doc["_drop"], per_doc["_links"]
    raw = F.split(text, "\n", -1)
    keep = F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), drop)
    kept_lines = _let(F.struct(raw.alias("raw"), keep.alias("keep")), lambda x: F.transform(x["keep"], lambda i: F.get(x["raw"], i)))
    cleaned = F.when(F.size(drop) > 0, F.array_join(kept_lines, "\n")).otherwise(text)
    made = {
        f"{prefix}n_lines": F.when(text.isNull(), 0).otherwise(F.size(raw)).cast("long"),
        f"{prefix}dropped_lines": F.when(drop.isNull(), 0).otherwise(F.size(drop)).cast("long"),
        f"{prefix}line_links": F.coalesce(links_of, F.lit(0)).cast("long"),
    }
    rest = [cleaned.alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns if c not in made]
    return joined.select(*rest, *[m.alias(n) for n, m in made.items()])


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "dropped_lines", "line_links", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


ORACLE_SQL = f"""
WITH raw AS (
    SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), every AS (
    SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM raw
), shown AS (
    SELECT doc_id, line_no, trim(line, ' ') AS line FROM every WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), first AS (
    SELECT line, min((doc_id, line_no)) AS place, length(line) AS n FROM shown GROUP BY line
), near AS (
    SELECT a.line, b.place FROM first a JOIN first b ON b.n BETWEEN a.n - {THRESHOLD} AND a.n + {THRESHOLD}
        AND a.n >= {MIN_CHARS} AND b.n >= {MIN_CHARS} AND a.line <> b.line AND levenshtein(a.line, b.line) <= {THRESHOLD}
), links AS (
    SELECT line, min(place) AS place, count(*) AS links FROM near GROUP BY line
), ruled AS (
    SELECT l.doc_id, l.line_no, coalesce(k.links, 0) AS links,
        (l.doc_id, l.line_no) > least(f.place, coalesce(k.place, f.place)) AS gone
    FROM shown l JOIN first f USING (line) LEFT JOIN links k USING (line)
), kept AS (
    SELECT e.doc_id, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS dropped_lines,
        sum(coalesce(links, 0)) AS line_links,
        coalesce(string_agg(e.line, chr(10) ORDER BY e.line_no) FILTER (NOT coalesce(gone, false)), '') AS text
    FROM every e LEFT JOIN ruled USING (doc_id, line_no) GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(dropped_lines, 0) AS BIGINT) AS dropped_lines,
    CAST(coalesce(line_links, 0) AS BIGINT) AS line_links, sha256(k.text) AS text_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
