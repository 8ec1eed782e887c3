"""Binary files: frames, raw sample dumps, length-prefixed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywire.functions.bits import COLD_WORD0, COLD_WORD1, FRAME_HEADER, compose, field, lit, pack_adcs, unpack_adcs
from tallywire.functions.scalars import floor_div
from tallywire.schema import CHANNELS, COMMA, FRAME_WORDS, SAMPLES_PER_PACKET, VERSION
from tallywire.sources.files import SPLIT, opened, read_fixed, read_range, write_fixed
from tallywire.sources.folders import written

#: Bytes of records that are read at once, and of a file that is looked at for sizes.
SPAN, WINDOW = 1 << 20, 1 << 16
#: Words of one of a frame's two streams: two of headers, twelve of samples.
STREAM_WORDS = 14


def decode_frames(frames: DataFrame, words: str = "words") -> DataFrame:
    """Frames (words array<long> of 30) as fields: the header's, tick, and streams array<struct<…, adcs array<long>>>; 64 channels in each of two."""
    w = lambda i: F.get(F.col(words), i)

    def stream(at: int) -> Column:
        head = [field(w(at), *COLD_WORD0[n]).alias(n) for n in COLD_WORD0] + [field(w(at + 1), *COLD_WORD1[n]).alias(n) for n in COLD_WORD1]
        adcs = [a for k in range(0, 12, 3) for a in unpack_adcs([w(at + 2 + k + i) for i in range(3)])]
        return F.struct(*head, F.array(*adcs).alias("adcs"))

    made = [field(w(0), *FRAME_HEADER[n]).alias(n) for n in FRAME_HEADER] + [w(1).alias("tick"), F.array(stream(2), stream(2 + STREAM_WORDS)).alias("streams")]
    return frames.select(*[c for c in frames.columns if c != words], *made)


def create_frames(samples: DataFrame, *, source: Column, tick: Column, number: Column, adcs: str = "adcs") -> DataFrame:
    """Sound frames (words) from 128 samples each: version, comma and counters as a sender would set them; convert counts start at 0x100."""
    convert = (number + 0x100).bitwiseAND(lit(0xFFFF))
    words = [compose(comma=(F.lit(COMMA), 0), version=(F.lit(VERSION), 8), id=(source, 13)), tick.cast("long")]
    for s in range(2):
        words += [compose(convert=(convert, 48)), lit(0)]
        for k in range(4):
            words += pack_adcs([F.get(F.col(adcs), 64 * s + 16 * k + i).cast("long") for i in range(16)])
    return samples.withColumn("words", F.array(*words))


def read_frames(spark: SparkSession, path: str, *, split: int = SPLIT) -> DataFrame:
    """(file, k, words): the frames of binary files, by byte ranges. A frame that is cut short ends its file."""
    return read_fixed(spark, path, word="i64", words=FRAME_WORDS, split=split).withColumnRenamed("n", "k")


def write_frames(frames: DataFrame, path: str, *, words: str = "words") -> None:
    """Frames (words) as binary files, one for each partition, in the order of its rows."""
    write_fixed(frames, path, word="i64", words=FRAME_WORDS, column=words)


def write_samples(packets: DataFrame, path: str, *, samples: int = SAMPLES_PER_PACKET, channels: int = CHANNELS, adcs: str = "adcs") -> None:
    """Packets, each an array of samples time-major, as dumps of unsigned 16-bit numbers."""
    write_fixed(packets, path, word="u16", words=samples * channels, column=adcs)


def read_samples(spark: SparkSession, path: str, *, samples: int = SAMPLES_PER_PACKET, channels: int = CHANNELS, split: int = SPLIT) -> DataFrame:
    """(file, pkt, ch, adcs array<int>): dumps of unsigned 16-bit samples, time-major, turned channel-major; read by byte ranges. A
    packet that is cut short ends its file."""

    def turned(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            grid = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, samples, channels).transpose(0, 2, 1)
            rows = batch.num_rows * channels
            of = pa.array(np.repeat(np.arange(batch.num_rows), channels))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * samples), pa.array(np.ascontiguousarray(grid, dtype=np.int32).ravel()))
            ch = pa.array(np.tile(np.arange(channels, dtype=np.int32), batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), ch, lists], names=["file", "pkt", "ch", "adcs"])

    packets = read_fixed(spark, path, word="u16", words=samples * channels, split=split)
    return packets.mapInArrow(turned, "file string, pkt long, ch int, adcs array<int>")


def read_records(spark: SparkSession, path: str, *, span: int = SPAN) -> DataFrame:
    """(file, n, at, type, payload): records of a 32-bit little-endian size whose top four bits are the type, and the payload. A
    record that is cut short ends its file.

    A task hops through a file from size to size and notes a row for each ``span`` bytes of whole records (or one larger record); spans are then
    read by many tasks, each at once."""

    def hop(batches):
        import pyarrow as pa

        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, place = opened(name)
                rows, at, n, begin, first, base, held = [], 0, 0, 0, 0, 0, b""
                with system.open_input_file(place) as file:
                    while at + 4 <= size:
                        if at + 4 > base + len(held):
                            base, held = at, file.read_at(min(WINDOW, size - at), at)
                        stop = at + 4 + (int.from_bytes(held[at - base : at - base + 4], "little") & 0x0FFFFFFF)
                        if stop > size:
                            break
                        if n > first and stop - begin > span:
                            rows.append((name, first, begin, at))
                            begin, first = at, n
                        at, n = stop, n + 1
                if n > first:
                    rows.append((name, first, begin, at))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "n", "at", "stop"])

    def take(batches):
        import pyarrow as pa

        for batch in batches:
            for name, n, begin, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, at, places, kinds, payloads = read_range(name, begin, stop - begin), 0, [], [], []
                while at < len(data):
                    head = int.from_bytes(data[at : at + 4], "little")
                    end = at + 4 + (head & 0x0FFFFFFF)
                    places.append(begin + at)
                    kinds.append(head >> 28)
                    payloads.append(data[at + 4 : end])
                    at = end
                numbers = pa.array(range(n, n + len(places)), pa.int64())
                columns = [pa.array([name] * len(places)), numbers, pa.array(places, pa.int64()), pa.array(kinds, pa.int32()), pa.array(payloads, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "n", "at", "type", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    listed = written(files.mapInArrow(hop, "file string, n long, at long, stop long"), "records")
    return listed.repartition(max(spark.sparkContext.defaultParallelism, listed.count() >> 6), "file", "n").mapInArrow(take, "file string, n long, at long, type int, payload binary")
