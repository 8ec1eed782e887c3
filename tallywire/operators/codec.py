"""An entropy codec for packets of one channel.

A packet's samples become a seed and zig-zag differences. Their histogram is the model: differences of 32 and more share a bin, and
are written aside in as many bits as the largest of them takes. The symbols are coded by an arithmetic coder in 32-bit
integers; a block begins with the seed, the histogram and the lengths that a reader needs.

Blocks are short and independent, so Spark deals them out and each task codes its own; a block is coded in one pass.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.schema import HISTOGRAM_BINS

_TOP = 1 << 32
_HALF, _QUARTER = _TOP >> 1, _TOP >> 2


class BitWriter:
    """Bits, first bit highest."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value = self.value << bits | value
        self.n += bits

    def bytes(self) -> bytes:
        pad = -self.n % 8
        return (self.value << pad).to_bytes((self.n + pad) // 8, "big")


class BitReader:
    def __init__(self, data: bytes):
        self.value, self.n, self.at = int.from_bytes(data, "big"), 8 * len(data), 0

    def get(self, bits: int) -> int:
        """The next bits; zeros behind the end."""
        left = self.n - self.at - bits
        self.at += bits
        return (self.value >> left if left >= 0 else self.value << -left) & ((1 << bits) - 1)


def arithmetic_encode(symbols: list[int], counts: list[int]) -> bytes:
    """Code symbols whose counts are known to the reader."""
    below = [0, *accumulate(counts)]
    total, low, high, pending = below[-1], 0, _TOP - 1, 0
    bits: list[str] = []

    def emit(bit: int) -> None:
        nonlocal pending
        bits.append("1" + "0" * pending if bit else "0" + "1" * pending)
        pending = 0

    for s in symbols:
        span = high - low + 1
        high, low = low + span * below[s + 1] // total - 1, low + span * below[s] // total
        while True:
            if high < _HALF:
                emit(0)
            elif low >= _HALF:
                emit(1)
                low, high = low - _HALF, high - _HALF
            elif low >= _QUARTER and high < _HALF + _QUARTER:
                pending += 1
                low, high = low - _QUARTER, high - _QUARTER
            else:
                break
            low, high = 2 * low, 2 * high + 1
    pending += 1
    emit(low >= _QUARTER)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def arithmetic_decode(data: bytes, n: int, counts: list[int]) -> list[int]:
    below = [0, *accumulate(counts)]
    total, low, high = below[-1], 0, _TOP - 1
    source = BitReader(data)
    code, out = source.get(32), []
    for _ in range(n):
        span = high - low + 1
        s = bisect_right(below, ((code - low + 1) * total - 1) // span) - 1
        out.append(s)
        high, low = low + span * below[s + 1] // total - 1, low + span * below[s] // total
        while True:
            if high < _HALF:
                away = 0
            elif low >= _HALF:
                away = _HALF
            elif low >= _QUARTER and high < _HALF + _QUARTER:
                away = _QUARTER
            else:
                break
            low, high, code = 2 * (low - away), 2 * (high - away) + 1, 2 * (code - away) + source.get(1)
    return out


def encode_histogram(counts: list[int], over_bits: int, samples: int, seed: int) -> bytes:
    """Seed (16 bits), samples (16), last bin (8), width of the widest count (8), bits of an overflow value (8), then each count in
    as many bits as what is left of the total or the widest one takes."""
    last = max((i for i, c in enumerate(counts) if c), default=0)
    widest = max(counts).bit_length()
    w = BitWriter()
    for value, bits in ((seed, 16), (samples, 16), (last, 8), (widest, 8), (over_bits, 8)):
        w.put(value, bits)
    left = samples - 1
    for c in counts[: last + 1]:
        w.put(c, min(left.bit_length(), widest))
        left -= c
    return w.bytes()


def decode_histogram(data: bytes) -> tuple[list[int], int, int, int, int]:
    """Counts, bits of an overflow value, samples, seed, and the bytes taken."""
    r = BitReader(data)
    seed, samples, last, widest, over_bits = r.get(16), r.get(16), r.get(8), r.get(8), r.get(8)
    counts, left = [], samples - 1
    for _ in range(last + 1):
        c = r.get(min(left.bit_length(), widest))
        counts.append(c)
        left -= c
    return counts + [0] * (HISTOGRAM_BINS - len(counts)), over_bits, samples, seed, (r.at + 7) // 8


def encode_packet(adcs: list[int]) -> bytes:
    """Samples of 0 to 65535, up to 65535 of them, as a block."""
    if not adcs:
        return b""
    deltas = [b - a for a, b in zip(adcs, adcs[1:], strict=False)]
    symbols = [2 * d if d > 0 else 1 - 2 * d for d in deltas]
    bins = [0 if s >= HISTOGRAM_BINS else s for s in symbols]
    over = [s - HISTOGRAM_BINS for s in symbols if s >= HISTOGRAM_BINS]
    counts = [0] * HISTOGRAM_BINS
    for b in bins:
        counts[b] += 1
    over_bits = max(over, default=0).bit_length()
    aside = BitWriter()
    for x in over:
        aside.put(x, over_bits)
    return encode_histogram(counts, over_bits, len(adcs), adcs[0]) + aside.bytes() + (arithmetic_encode(bins, counts) if bins else b"")


def decode_packet(block: bytes) -> list[int]:
    if not block:
        return []
    counts, over_bits, samples, seed, at = decode_histogram(block)
    stop = at + (counts[0] * over_bits + 7) // 8
    aside = BitReader(block[at:stop])
    out = [seed]
    for s in arithmetic_decode(block[stop:], samples - 1, counts) if samples > 1 else ():
        if s == 0:
            s = HISTOGRAM_BINS + aside.get(over_bits)
        out.append(out[-1] + (-(s >> 1) if s & 1 else s >> 1))
    return out


def _map_arrays(df: DataFrame, column: str, made: T.StructField, work) -> DataFrame:
    """``df`` with a column made from another one, row by row in Arrow batches."""
    kept = [f for f in df.schema if f.name not in (column, made.name)]
    schema = T.StructType([*kept, made])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(made.dataType)
        for batch in batches:
            values = [None if x is None else work(x) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(values, type=kind)], names=schema.names)

    return df.select(*[f.name for f in kept], column).mapInArrow(run, schema)


def encode(packets: DataFrame, column: str = "adcs", out: str = "block") -> DataFrame:
    """Replace arrays of samples by blocks. Null arrays stay null."""
    return _map_arrays(packets, column, T.StructField(out, T.BinaryType()), encode_packet)


def decode(packets: DataFrame, column: str = "block", out: str = "adcs") -> DataFrame:
    return _map_arrays(packets, column, T.StructField(out, T.ArrayType(T.LongType())), decode_packet)


def compressed_packets(blocks: DataFrame, keys: tuple[str, ...], channel: str = "ch") -> DataFrame:
    """A record for each packet: its channels' blocks behind each other, and a table of contents of bit offsets, one more than channels."""
    parts = F.sort_array(F.collect_list(F.struct(channel, "block")))
    rows = blocks.groupBy(*keys).agg(parts.alias("parts"))
    sizes = F.transform("parts", lambda p: F.length(p["block"]).cast("long") * 8)
    # offsets of a packet's few channels (128 in a link)
    toc = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    payload = F.aggregate(F.transform("parts", lambda p: p["block"]), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    return rows.select(*keys, F.transform("parts", lambda p: p[channel]).alias("channels"), toc.alias("toc"), payload.alias("payload"))


def split_packets(records: DataFrame, keys: tuple[str, ...], channel: str = "ch") -> DataFrame:
    """Blocks again: (keys, channel, block)."""
    rows = records.select(*keys, "toc", "payload", F.posexplode("channels").alias("i", channel))
    begin = (F.get("toc", F.col("i")) / 8).cast("int")
    size = ((F.get("toc", F.col("i") + 1) - F.get("toc", F.col("i"))) / 8).cast("int")
    return rows.select(*keys, channel, F.substring("payload", begin + 1, size).alias("block"))
