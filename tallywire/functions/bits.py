"""Bit fields, records and number forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywire.schema import TRAILER_PATTERN


def lit(x: int) -> Column:
    return F.lit(x).cast("long")


def field(word: Column, offset: int, bits: int) -> Column:
    """Bits ``offset`` to ``offset + bits - 1`` of a 64-bit word, as an unsigned number."""
    moved = F.shiftrightunsigned(word, offset) if offset else word
    return moved.bitwiseAND(lit((1 << bits) - 1))


def compose(**fields: tuple[Column, int]) -> Column:
    """A word from fields, each a value and its offset; a value must fit below the next field."""
    out = lit(0)
    for value, offset in fields.values():
        out = out.bitwiseOR(F.shiftleft(value.cast("long"), offset))
    return out


def fields(word: Column, layout: dict[str, tuple[int, int]]) -> list[Column]:
    return [field(word, offset, bits).alias(name) for name, (offset, bits) in layout.items()]


# Fixed values: (offset, bits) of each field.
FRAME_HEADER = {"comma": (0, 8), "version": (8, 5), "id": (13, 11), "rsvd": (24, 24), "errors": (48, 16)}
COLD_WORD0 = {"stream_err1": (0, 4), "stream_err2": (4, 4), "rsvd0": (8, 8), "checksums": (16, 32), "convert": (48, 16)}
COLD_WORD1 = {"err_reg": (0, 16), "rsvd1": (16, 16), "hdrs": (32, 32)}
RECORD_HEADER0 = {"format": (0, 4), "type": (4, 4), "length": (8, 24), "naux64": (32, 4), "subtype": (36, 4), "bridge": (40, 24)}
RECORD_HEADER1 = {"format": (0, 4), "type": (4, 4), "length": (8, 24), "specific": (32, 32)}
RECORD_HEADER2 = {"format": (0, 4), "type": (4, 4), "length": (8, 24), "specific": (32, 32)}
STREAM_BRIDGE = {"format": (0, 4), "csf": (4, 12), "left": (16, 8), "status": (24, 8)}
TOC_ENTRY = {"format": (0, 4), "type": (4, 4), "offset64": (8, 24)}
TRAILER = {"nbytes": (0, 24), "record_type": (24, 4), "frame_type": (28, 4), "status": (32, 32)}
EXCEPTION = {"frame": (0, 10), "mask": (10, 6)}
VERSION_PARTS = {"patch": (0, 8), "release": (8, 8), "minor": (16, 8), "major": (24, 8)}


def trailer_words(status: Column, frame_type: Column, record_type: Column, nbytes: Column, version: Column) -> tuple[Column, Column]:
    first = compose(a=(nbytes, 0), b=(record_type, 24), c=(frame_type, 28), d=(status, 32))
    return first, compose(a=(version, 0), b=(lit(TRAILER_PATTERN), 32))


def complement(word: Column) -> Column:
    """The trailer of a record: its header with every bit turned."""
    return F.bitwise_not(word)


def csf(wire_id: Column) -> Column:
    """Crate, slot and fiber (5, 3, 3 bits) from an id in wire order: slot, crate, fiber (3, 5, 3 bits)."""
    return compose(crate=(field(wire_id, 3, 5), 6), slot=(field(wire_id, 8, 3), 3), fiber=(field(wire_id, 0, 3), 0))


def zigzag(delta: Column) -> Column:
    """Symbols of differences: positive ones even, others odd."""
    return F.when(delta > 0, 2 * delta).otherwise(-2 * delta + 1)


def unzigzag(symbol: Column) -> Column:
    half = F.shiftright(symbol, 1)
    return F.when(symbol % 2 == 1, -half).otherwise(half)


def bit_length(x: Column) -> Column:
    """Bits of a non-negative number: 0 for 0."""
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0)


def count_ones(x: Column, bits: int = 64) -> Column:
    """Bits that are set among the low ``bits`` of a word."""
    return F.bit_count(field(x, 0, bits) if bits < 64 else x).cast("long")


def find_first(x: Column, bits: int = 32) -> Column:
    """Place of the first set bit of a word of ``bits``, the leftmost being 0; ``bits`` if none is set."""
    return (bits - bit_length(field(x, 0, bits))).cast("long")


def find_last(x: Column, bits: int = 32) -> Column:
    """Place of the last set bit from the right; ``bits`` if none is set."""
    low = field(x, 0, bits)
    lowest = low.bitwiseAND(F.bitwise_not(low) + 1)
    return F.when(low == 0, bits).otherwise(bit_length(lowest) - 1).cast("long")


def extract_left(x: Column, at: int, n: int, bits: int = 32) -> Column:
    """``n`` bits of a word of ``bits`` from place ``at``, counted from the left."""
    return field(x, bits - at - n, n)


def tree_counts(mask: Column, bits: int = 32) -> dict[str, Column]:
    """Of the binary tree over a mask (a node is set if any bit below it is), the pairs of siblings that are 01, 10 and 11 (right, left, both
    set), over all levels. A level is the one below it, its pairs joined by OR; a pair is counted where both levels' bits still stand
    in place, spread by the level's width."""
    counts = {"n01": lit(0), "n10": lit(0), "n11": lit(0)}
    level, width = field(mask, 0, bits), 1
    while width < bits:
        places = lit(sum(1 << i for i in range(0, bits, 2 * width)))
        right, left = level.bitwiseAND(places), F.shiftrightunsigned(level, width).bitwiseAND(places)
        for name, pair in (("n01", right.bitwiseAND(F.bitwise_not(left))), ("n10", left.bitwiseAND(F.bitwise_not(right))), ("n11", right.bitwiseAND(left))):
            counts[name] = counts[name] + F.bit_count(pair)
        level, width = right.bitwiseOR(left), 2 * width
    return counts


def tree_size(mask: Column, bits: int = 32) -> Column:
    """struct<scheme, bits>: how a mask is coded shortest as a binary tree. A pair of siblings takes two bits, but one for the pattern that
    the scheme favours (1: 01, 2: 10, 3: 11) and none where nothing is set; scheme 0 is the mask itself, which an empty one is too.
    Of equal sizes the lowest scheme counts, but the mask itself only if it is shorter than scheme 1."""
    n = tree_counts(mask, bits)
    twice = 2 * (n["n01"] + n["n10"] + n["n11"])
    sizes = [twice - n["n01"], twice - n["n10"], twice - n["n11"]]
    best = F.when(lit(bits) < sizes[0], F.struct(lit(0).alias("scheme"), lit(bits).alias("bits"))).otherwise(F.struct(lit(1).alias("scheme"), sizes[0].alias("bits")))
    for scheme, size in ((2, sizes[1]), (3, sizes[2])):
        best = F.transform(F.array(best), lambda b: F.when(size < b["bits"], F.struct(lit(scheme).alias("scheme"), size.alias("bits"))).otherwise(b))[0]  # noqa: B023
    return F.when(field(mask, 0, bits) == 0, F.struct(lit(0).alias("scheme"), lit(bits).alias("bits"))).otherwise(best)


def unpack_adcs(words: list[Column]) -> list[Column]:
    """Sixteen 12-bit samples of three 64-bit words: groups of 48 bits in which the high nibbles of a pair share a byte."""
    w0, w1, w2 = words
    groups = [
        field(w0, 0, 48),
        field(w0, 48, 16).bitwiseOR(F.shiftleft(field(w1, 0, 32), 16)),
        field(w1, 32, 32).bitwiseOR(F.shiftleft(field(w2, 0, 16), 32)),
        field(w2, 16, 48),
    ]
    out = []
    for g in groups:
        join = lambda high, high_bits, low, low_bits: F.shiftleft(field(g, high, high_bits), low_bits).bitwiseOR(field(g, low, low_bits))  # noqa: B023, E731
        out += [join(16, 4, 0, 8), join(24, 4, 8, 8), join(32, 8, 20, 4), join(40, 8, 28, 4)]
    return out


def pack_adcs(adcs: list[Column]) -> list[Column]:
    """The inverse of :func:`unpack_adcs`."""
    groups = []
    for k in range(0, 16, 4):
        a0, a1, a2, a3 = adcs[k : k + 4]
        low = compose(a=(field(a0, 0, 8), 0), b=(field(a1, 0, 8), 8), c=(field(a0, 8, 4), 16), d=(field(a2, 0, 4), 20))
        high = compose(a=(field(a1, 8, 4), 24), b=(field(a3, 0, 4), 28), c=(field(a2, 4, 8), 32), d=(field(a3, 4, 8), 40))
        groups.append(low.bitwiseOR(high))
    g0, g1, g2, g3 = groups
    return [
        g0.bitwiseOR(F.shiftleft(field(g1, 0, 16), 48)),
        field(g1, 16, 32).bitwiseOR(F.shiftleft(field(g2, 0, 32), 32)),
        field(g2, 32, 16).bitwiseOR(F.shiftleft(g3, 16)),
    ]


def little_endian(data: Column, at: int, n: int = 4) -> Column:
    """An unsigned number of ``n`` bytes of a binary column, from byte ``at`` (0 is the first)."""
    return F.conv(swapped(F.hex(F.substring(data, at + 1, n)), n), 16, 10).cast("decimal(20,0)").cast("long")


def digits_of(word: Column, n: int = 8) -> Column:
    """The n low bytes of a word as hexadecimal digits, least byte first: as they stand in a file."""
    if n == 2:
        low = word.cast("long").bitwiseAND(lit(0xFFFF))
        turned = F.shiftleft(low.bitwiseAND(lit(0xFF)), 8).bitwiseOR(F.shiftright(low, 8)).bitwiseOR(lit(0x10000))
        return F.substring(F.hex(turned), 2, 4)
    return swapped(F.substring(F.lpad(F.hex(word.cast("long")), 16, "0"), 17 - 2 * n, 2 * n), n)


def word_at(data: Column, at: Column, n: int = 8) -> Column:
    """The little-endian number of ``n`` bytes from byte ``at`` (0 is the first) of a binary column; one of eight is signed."""
    taken = F.conv(swapped(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(n))), n), 16, -10)
    return taken.cast("decimal(20,0)").cast("long")


def swapped(digits: Column, n: int) -> Column:
    """Hexadecimal digits of n bytes with the bytes in the other order."""
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(n - 1, -1, -1)])


def words_up(n: Column, unit: int) -> Column:
    """Units of ``unit`` that hold n."""
    return F.call_function("div", (n + (unit - 1)).cast("long"), F.lit(unit).cast("long"))


def line_checksum(digits: Column) -> Column:
    """Sum of the bytes of a string of hexadecimal digits, modulo 256: 0 for a sound record with its checksum."""
    bytes_ = F.transform(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(bytes_, lit(0), lambda a, x: a + x) % 256
