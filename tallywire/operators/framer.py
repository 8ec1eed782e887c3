"""Frames of a serial link's symbols: start, 120 words, a checksum of two words, an idle symbol.

A receiver that waits for a start takes the next one and then 122 symbols more, whatever they are: a start among these is a wrong
symbol, not a start. Where frames are so depends on all symbols before, yet lanes are few and long:

* What goes into a block of positions is how many of its first symbols still belong to a frame begun before, 0 to 122. A block is a
  map of these 123 numbers to those it hands on, made from its starts alone.
* Maps are put together, by thousands and then those, which gives every block its number.
* Each block then places its own symbols.

Defined cases: symbols are told by their place in the lane; a block without symbols, or a gap, ends a frame; a null lane is a lane;
a frame that is not whole gives no row; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.functions.bits import digits_of
from tallywire.functions.scalars import floor_div
from tallywire.schema import COMMA

# Words of a frame with its start, all symbols with checksum and idle, the idle symbol.
WORDS, SYMBOLS, IDLE = 120, 123, 0x5C3C
#: Positions of a block, and blocks that are put together at a time.
BLOCK, FAN = 1 << 14, 1 << 12


def _ahead(starts: list[int], block: int) -> list[int]:
    """What a block hands on, for each number of symbols that it is handed."""
    import bisect

    after = [0] * (len(starts) + 1)  # from each start on; behind the last one nothing is open
    for i in range(len(starts) - 1, -1, -1):
        end = starts[i] + SYMBOLS
        after[i] = end - block if end >= block else after[bisect.bisect_left(starts, end)]
    return [after[bisect.bisect_left(starts, e)] for e in range(SYMBOLS)]


def _row(table, names: list[str], values: list, types: dict):
    import pyarrow as pa

    return pa.table({n: pa.array([v], types[n]) for n, v in zip(names, values, strict=True)})


def _composed(numbers: list[int], maps: list[list[int]], entry: list[int]) -> tuple[list[list[int]], list[int]]:
    """Before each block, what it is handed for each number that the run was handed; and what the run hands on."""
    handed, last = [], None
    for number, ahead in zip(numbers, maps, strict=True):
        if last is not None and number != last + 1:
            entry = [0] * len(entry)  # blocks without symbols
        handed.append(entry)
        entry, last = [ahead[e] for e in entry], number
    return handed, entry


def _starts(table, free: int) -> tuple:
    """Of symbols sorted by place: their places, the start of the last frame that begins at or before each, and whether it holds it. The first
    frame begins at or behind ``free``; one begun before ends there."""
    import numpy as np

    there = table.column("_pos").is_valid().to_numpy()
    pos = table.column("_pos").fill_null(1 << 62).to_numpy()
    begins = pos[table.column("_begins").to_numpy().astype(bool) & there]
    firsts, i = [free - SYMBOLS], np.searchsorted(begins, free)
    while i < len(begins):
        firsts.append(int(begins[i]))
        i = np.searchsorted(begins, firsts[-1] + SYMBOLS)
    start = np.array(firsts)[np.searchsorted(firsts, pos, side="right") - 1]
    return pos, start, there & (pos - start < SYMBOLS)


def _entered(symbols: DataFrame, key: str, order: str, block: int) -> DataFrame:
    """Adds to symbols _key, _block, _begins, _pos, and entry: of the block's first places, how many belong to a frame begun before."""
    import pyarrow as pa

    columns, long = [c for c in symbols.columns if c not in ("start", "i")], T.LongType()
    own = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    begins = F.col("valid") & (F.col("control") == 1) & (F.col("word").bitwiseAND(F.lit(0xFF)) == COMMA)
    rows = symbols.select(*columns, own.alias("_key"), floor_div(F.col(order), block).alias("_block"), F.coalesce(begins, F.lit(False)).alias("_begins"), F.col(order).cast("long").alias("_pos"))

    def look(table: pa.Table) -> pa.Table:
        number = table.column("_block")[0].as_py()
        starts = sorted(p - number * block for p in table.column("_pos").to_pylist() if p is not None)
        return pa.table({"_key": table.column("_key")[:1], "_block": table.column("_block")[:1], "ahead": pa.array([_ahead(starts, block)], pa.list_(pa.int64()))})

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        numbers = table.column("_block").to_pylist()
        _, out = _composed(numbers, table.column("ahead").to_pylist(), list(range(SYMBOLS)))
        made = {"_key": table.column("_key")[:1], "_group": table.column("_group")[:1], "low": [numbers[0]], "high": [numbers[-1]]}
        return pa.table(made | {"ahead": pa.array([out], pa.list_(pa.int64()))})

    def hand(table: pa.Table) -> pa.Table:
        table = table.sort_by("_group")
        entry, last, given = 0, None, []
        for low, high, ahead in zip(*(table.column(c).to_pylist() for c in ("low", "high", "ahead")), strict=True):
            entry = entry if last is not None and low == last + 1 else 0
            given.append(entry)
            entry, last = ahead[entry], high
        return pa.table({"_key": table.column("_key"), "_group": table.column("_group"), "entry": pa.array(given, pa.int64())})

    def within(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        handed, _ = _composed(table.column("_block").to_pylist(), table.column("ahead").to_pylist(), [table.column("entry")[0].as_py()])
        return pa.table({"_key": table.column("_key"), "_block": table.column("_block"), "entry": pa.array([h[0] for h in handed], pa.int64())})

    of = lambda *fields: T.StructType([T.StructField("_key", T.StringType()), *[T.StructField(n, t) for n, t in fields]])
    ahead = ("ahead", T.ArrayType(long))
    # a block without starts hands on nothing, but it is there: what it is handed must not reach the next one as a gap would
    found = rows.select("_key", "_block", F.when(F.col("_begins"), F.col("_pos")).alias("_pos"))
    ends = found.groupBy("_key", "_block").agg(F.collect_list("_pos").alias("_all"))
    few = ends.select("_key", "_block", F.explode_outer("_all").alias("_pos")).groupBy("_key", "_block").applyInArrow(look, of(("_block", long), ahead))
    few = few.withColumn("_group", floor_div(F.col("_block"), FAN))
    groups = few.groupBy("_key", "_group").applyInArrow(join, of(("_group", long), ("low", long), ("high", long), ahead))
    given = groups.groupBy("_key").applyInArrow(hand, of(("_group", long), ("entry", long)))
    # symbols and maps are dealt out by their block and group, never broadcast: where symbols are exploded from a small table, Spark
    # takes them for small and would gather them all in the driver
    entries = few.join(given.hint("merge"), ["_key", "_group"]).groupBy("_key", "_group").applyInArrow(within, of(("_block", long), ("entry", long)))
    return rows.join(entries.hint("merge"), ["_key", "_block"])


def place(symbols: DataFrame, *, key: str = "lane", order: str = "pos", block: int = BLOCK) -> DataFrame:
    """Adds start and i to symbols (key, order, word, control, valid): the place of the frame's start, and the symbol's number in the frame;
    both null outside of frames."""
    import pyarrow as pa

    columns, long = [c for c in symbols.columns if c not in ("start", "i")], T.LongType()
    rows = _entered(symbols, key, order, block)

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        pos, start, inside = _starts(table, table.column("_block")[0].as_py() * block + table.column("entry")[0].as_py())
        found = {"start": pa.array(start, pa.int64(), mask=~inside), "i": pa.array(pos - start, pa.int64(), mask=~inside)}
        return pa.table({c: table.column(c) for c in columns} | found)

    made = T.StructType([*[rows.schema[c] for c in columns], T.StructField("start", long), T.StructField("i", long)])
    return rows.groupBy("_key", "_block").applyInArrow(settle, made)


def received(symbols: DataFrame, *, key: str = "lane", order: str = "pos", block: int = BLOCK) -> DataFrame:
    """What ``framed`` makes of placed symbols, straight from symbols (key, order, word, control, valid): a block hands on a row for each frame, or
    part of one, and not its symbols."""
    import pyarrow as pa

    rows = _entered(symbols.select(key, order, "word", "control", "valid"), key, order, block).drop(*{order} - {key})

    def take(table: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow.compute as pc

        table = table.sort_by([("_pos", "ascending"), ("word", "ascending")])
        pos, start, inside = _starts(table, table.column("_block")[0].as_py() * block + table.column("entry")[0].as_py())
        table, pos, start = table.filter(pa.array(inside)), pos[inside], start[inside]
        i, size = pos - start, len(pos)
        is_not = lambda name, value: pc.fill_null(pc.not_equal(table.column(name), value), False).to_numpy().astype(bool)
        bad, last = is_not("valid", True), i == SYMBOLS - 1
        wrong = np.where(last, bad | is_not("control", 3) | is_not("word", IDLE), (i > 0) & (bad | is_not("control", 0)))
        at = np.flatnonzero(np.append(True, start[1:] != start[:-1])) if size else np.zeros(0, dtype=np.int64)
        words = pc.cast(table.column("word"), pa.int32(), safe=False).combine_chunks()
        made = {key: table.column(key).take(pa.array(at)), "start": start[at], "i": i[at], "words": pa.ListArray.from_arrays(pa.array(np.append(at, size), pa.int32()), words)}
        return pa.table(made | {"wrong": np.logical_or.reduceat(wrong, at) if size else wrong})

    long = T.LongType()
    made = T.StructType([rows.schema[key], T.StructField("start", long), T.StructField("i", long), T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("wrong", T.BooleanType())])
    parts = rows.groupBy("_key", "_block").applyInArrow(take, made)
    frames = parts.groupBy(key, "start").agg(F.sort_array(F.collect_list(F.struct("i", "words"))).alias("all"), F.max("wrong").alias("length_error"))
    return _verified(frames.withColumn("every", F.flatten(F.transform("all", lambda x: x["words"]))).filter(F.size("every") == SYMBOLS), key)


def framed(placed: DataFrame, *, key: str = "lane") -> DataFrame:
    """(key, start, words array<int>, length_error, crc_error, eof_error) of placed symbols: whole frames. Wrong symbols among the words or the
    checksum, or no idle behind it, are an error of length; the checksum (CRC-32 of the words' bytes) counts if there is none."""
    inside = F.col("i").between(1, SYMBOLS - 2)
    wrong = F.when(inside, ~F.col("valid") | (F.col("control") != 0)).when(F.col("i") == SYMBOLS - 1, ~F.col("valid") | (F.col("control") != 3) | (F.col("word") != IDLE))
    taken = F.sort_array(F.collect_list(F.struct("i", "word")))
    frames = placed.filter("start IS NOT NULL").groupBy(key, "start").agg(taken.alias("all"), F.max(F.coalesce(wrong, F.lit(False))).alias("length_error"))
    frames = frames.filter(F.size("all") == SYMBOLS).withColumn("every", F.transform("all", lambda x: x["word"].cast("int")))
    return _verified(frames, key)


def _verified(frames: DataFrame, key: str) -> DataFrame:
    """Frames (key, start, every, length_error) with their checksum looked at."""
    words = F.slice("every", 1, WORDS)
    at = lambda i: F.get("every", F.lit(i)).cast("long")
    told = at(WORDS).bitwiseOR(F.shiftleft(at(WORDS + 1), 16))
    right = F.crc32(F.unhex(F.array_join(F.transform(words, lambda w: digits_of(w, 2)), ""))) == told
    crc = ~F.col("length_error") & ~right
    return frames.select(key, "start", words.alias("words"), "length_error", crc.alias("crc_error"), (F.col("length_error") | crc).alias("eof_error"))
