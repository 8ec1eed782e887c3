"""Records in byte streams with damage: found in parallel, as a sequential reader would find them.

A record begins with a header of four little-endian 32-bit words, the first of which is its size in bytes, header and all (a size
below the header's is the header alone). After a header whose size is beyond ``LARGEST_MESSAGE`` a reader passes over words, by fours
from there, to the marker and goes on behind it. Where a record begins is known from the one before it only, yet files are
read in blocks by many tasks:

* A state is a place, and whether a header or a word to pass over is expected there. A block takes each state that it can be
  entered in to the first one beyond it: one step for every byte by array operations, then pointer doubling within the block.
* Nearly all of them meet, so the states that blocks are left in are few. Only these are entries; a second look takes each
  entry of a block to its exit: rows (file, state, next).
* From a file's first state, pointer doubling over these rows (a join with themselves, then with the states reached so far) finds
  the entry of every block in as many rounds as the number of blocks has bits.
* A third look reads the records of each block from its entry.

Files are listed by Spark. A task holds a block and arrays of some 40 bytes for each of its bytes.

Defined cases: an empty file has no records; a header or record that the file's end cuts short is its last, a row without data;
after a damaged header without a marker behind it nothing follows; an empty folder gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywire.functions.scalars import floor_div
from tallywire.schema import LARGEST_MESSAGE, TRAILER_PATTERN
from tallywire.sources.files import read_range
from tallywire.sources.folders import written

HEADER = 16
#: Bytes of a block; blocks that a task takes on.
BLOCK, BLOCKS_PER_TASK = 1 << 20, 16


def blocks_of(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, size, start): the blocks of files, without reading them."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size")).filter("size > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("start")
    listed = written(files.select("file", "size", starts), "blocks")
    tasks = max(listed.count() // BLOCKS_PER_TASK, spark.sparkContext.defaultParallelism)
    return listed.repartition(min(tasks, 1 << 16))  # rows are small but work is not: the number is not left to their size


def _steps(raw: bytes, here: int, left: int):
    """For each byte of a block, the state beyond the block that a header there leads to; and the same for words to pass over at
    its first bytes, as a header before the block may end in it. States are 2 * place + kind, places within the block's frame; -1 is the file's end."""
    import numpy as np

    data = np.frombuffer(raw.ljust(here + HEADER + 4, b"\0"), dtype=np.uint8).astype(np.uint32)
    word = data[: here + 4] | data[1 : here + 5] << 8 | data[2 : here + 6] << 16 | data[3 : here + 7] << 24
    place = np.arange(here + HEADER + 4, dtype=np.int64)
    # the next marker at or after each place, by fours; beyond the block, the first word to pass over there
    marker = (word[:here] == TRAILER_PATTERN) & (place[:here] + 4 <= left)
    follows = np.empty(here + HEADER + 4, dtype=np.int64)
    for phase in range(4):
        lane = place[phase:here:4]
        beyond = here + (phase - here) % 4
        found = np.append(np.where(marker[phase:here:4], 2 * (lane + 4), 2 * beyond + 1), 2 * beyond + 1)
        far = found == 2 * beyond + 1
        at = np.where(far, len(found), np.arange(len(found)))
        at = np.minimum(np.minimum.accumulate(at[::-1])[::-1], len(found) - 1)
        follows[phase:here:4] = found[at[:-1]] if len(lane) else found[:0]
    follows[here:] = 2 * place[here:] + 1
    size = np.maximum(word[:here].astype(np.int64), HEADER)
    after = np.where(size > LARGEST_MESSAGE, follows[HEADER : here + HEADER], 2 * (place[:here] + size))
    after[(place[:here] + HEADER > left) | (after >> 1 >= left)] = -1
    over = follows[:HEADER].copy()
    over[over >> 1 >= left] = -1
    inside = np.flatnonzero((after >= 0) & (after < 2 * here))
    while len(inside):
        after[inside] = after[after[inside] >> 1]
        inside = inside[(after[inside] >= 0) & (after[inside] < 2 * here)]
    again = (over >= 0) & (over < 2 * here)
    over[again] = after[over[again] >> 1]
    return after, over


def _exits(after, over, entries, start: int):
    """The states that a block is left in, for states it is entered in; None are all."""
    import numpy as np

    if entries is None:
        left = np.unique(np.concatenate([after, over]) if start else after[:1])
        return left[left >= 0] + 2 * start
    entries = np.asarray(entries, dtype=np.int64) - 2 * start
    out = np.where(entries & 1, over[np.minimum(entries >> 1, HEADER - 1)], after[np.minimum(entries >> 1, len(after) - 1)])
    return np.where(out >= 0, out + 2 * start, -1)


def _looked(blocks: DataFrame, block: int, entries: bool) -> DataFrame:
    """Exits (file, state) of blocks; of given ``entries`` (array<long>) of each, (file, state, next)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                here = min(block, row["size"] - row["start"])
                after, over = _steps(read_range(row["file"], row["start"], here + HEADER + 4), here, row["size"] - row["start"])
                out = _exits(after, over, row["entries"] if entries else None, row["start"])
                columns = [pa.array([row["file"]] * len(out), pa.string())] + ([pa.array(row["entries"], pa.int64())] if entries else []) + [pa.array(out, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "state", "next"] if entries else ["file", "state"])

    return blocks.mapInArrow(run, "file string, state long, next long" if entries else "file string, state long")


def _with_entries(blocks: DataFrame, states: DataFrame, block: int) -> DataFrame:
    """Blocks with the states they are entered in."""
    start = (floor_div(floor_div(F.col("state"), 2), block) * block).alias("start")
    of = states.select("file", "state", start).groupBy("file", "start").agg(F.collect_list("state").alias("entries"))
    return blocks.join(of, ["file", "start"]).repartition(blocks.rdd.getNumPartitions())


def entries_of(spark: SparkSession, blocks: DataFrame, block: int) -> DataFrame:
    """(file, state): the one state that each block is entered in by a reader that begins at its file's start."""
    first = blocks.filter("start = 0").select("file", F.lit(0).cast("long").alias("state"))
    states = written(_looked(blocks, block, False).unionByName(first).distinct(), "states")
    jumps = written(_looked(_with_entries(blocks, states, block), block, True).filter("next >= 0"), "jumps")
    reached = first
    while not jumps.isEmpty():
        ahead = reached.join(jumps, ["file", "state"]).select("file", F.col("next").alias("state"))
        reached = written(reached.unionByName(ahead).distinct(), "reached")
        twice = jumps.join(jumps.select("file", F.col("state").alias("next"), F.col("next").alias("far")), ["file", "next"])
        jumps = written(twice.select("file", "state", F.col("far").alias("next")), "jumps")
    return reached


def read_slices(spark: SparkSession, path: str, *, block: int = BLOCK) -> DataFrame:
    """(file, at, size, sequence, second, type, kind, data): what a reader meets, in order of ``at``: records with their bytes, headers of a
    ``damaged`` size, and what is ``cut`` by the file's end."""
    blocks = blocks_of(spark, path, block)
    entered = _with_entries(blocks, entries_of(spark, blocks, block), block)

    def run(batches: Iterator) -> Iterator:
        import struct

        import pyarrow as pa

        names = ["file", "at", "size", "sequence", "second", "type", "kind", "data"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        marker = struct.pack("<I", TRAILER_PATTERN)
        for batch in batches:
            for row in batch.to_pylist():
                name, start, whole = row["file"], row["start"], row["size"]
                end = min(start + block, whole)
                raw = read_range(name, start, end - start + LARGEST_MESSAGE + HEADER)
                (state,) = row["entries"]
                at, passing, rows = state >> 1, state & 1, []
                while at < end:
                    if passing:
                        found = raw.find(marker, at - start)
                        while found >= 0 and (found - (at - start)) % 4:
                            found = raw.find(marker, found + 1)
                        if found < 0 or start + found >= end:
                            break  # the block that holds the marker goes on
                        at, passing = start + found + 4, 0
                        continue
                    if at + HEADER > whole:
                        rows.append((name, at, None, None, None, None, "cut", None))
                        break
                    size, *others = struct.unpack_from("<4I", raw, at - start)
                    if size > LARGEST_MESSAGE:
                        rows.append((name, at, size, *others, "damaged", None))
                        at, passing = at + HEADER, 1
                    elif at + max(size, HEADER) > whole:
                        rows.append((name, at, size, *others, "cut", None))
                        break
                    else:
                        length = max(size, HEADER)
                        rows.append((name, at, size, *others, "record", raw[at - start : at - start + length]))
                        at += length
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return entered.mapInArrow(run, "file string, at long, size long, sequence long, second long, type long, kind string, data binary")
