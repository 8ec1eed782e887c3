"""Scalar conversions of times, units, names and enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywire.functions.bits import VERSION_PARTS, field
from tallywire.schema import TICK_NS


def floor_div(n: Column, by: Column | int) -> Column:
    """The whole part of a quotient of integers, rounded down, without a detour over doubles: right for all of 64 bits."""
    by = by if isinstance(by, Column) else F.lit(by).cast("long")
    n = n.cast("long")
    return F.call_function("div", n - F.pmod(n, by), by)


def ticks(micros: Column) -> Column:
    """Clock ticks of a time in microseconds, rounded to the nearest."""
    return floor_div(1000 * micros + TICK_NS // 2, TICK_NS)


def string_words(text: Column) -> Column:
    """A text as a device keeps it: its bytes and a zero, in 32-bit words of least byte first."""
    data = F.concat(F.encode(text, "UTF-8"), F.lit(b"\0\0\0\0"))
    count = floor_div(F.octet_length(text) + 4, 4).cast("int")

    def word(i: Column) -> Column:
        digits = F.hex(F.substring(data, 4 * i + 1, F.lit(4)))
        return F.conv(F.concat(*[F.substring(digits, 2 * b + 1, F.lit(2)) for b in (3, 2, 1, 0)]), 16, 10).cast("long")

    return F.transform(F.sequence(F.lit(0), count - 1), word)


def words_string(words: Column) -> Column:
    """The text of such words, up to the first zero."""
    swap = lambda d: F.concat(*[F.substring(d, 2 * b + 1, F.lit(2)) for b in (3, 2, 1, 0)])
    digits = F.array_join(F.transform(words, lambda w: swap(F.lpad(F.hex(w), 8, "0"))), "")
    return F.substring_index(F.decode(F.unhex(digits), "UTF-8"), "\0", 1)


def version_string(word: Column) -> Column:
    parts = [field(word, *VERSION_PARTS[p]).cast("int") for p in ("major", "minor", "release", "patch")]
    return F.format_string("%d.%d.%d.%d", *parts)


def linear(value: Column, a: float, b: float, c: float) -> Column:
    """((value + a) * b) + c in doubles."""
    return (value.cast("double") + a) * b + c


def with_unit(value: Column, unit: str, digits: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", value), F.lit(f" {unit}"))


def number_or_zero(text: Column, kind: str = "long") -> Column:
    """A number as the text says; 0 where it says none."""
    return F.coalesce(text.try_cast(kind), F.lit(0).cast(kind))


def parse_int(text: Column) -> Column:
    """Decimal, 0x hexadecimal or 0b binary digits; 0 for anything else."""
    lower = F.lower(text)
    hexed = F.when(lower.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(lower, 3, 64), 16, 10))
    binary = F.when(lower.rlike("^0b[01]{1,62}$"), F.conv(F.substring(lower, 3, 64), 2, 10))
    return F.coalesce(hexed, binary, text).try_cast("long")


def strip(text: Column) -> Column:
    """Without blanks and line ends."""
    return F.regexp_replace(text, r"[ \n\r\t]", "")


def path_of(parts: list[tuple[Column, Column | None]]) -> Column:
    """``a:b(1):c`` from names and indices; an index that is null is left out."""
    said = [name if index is None else F.concat(name, F.coalesce(F.concat(F.lit("("), index.cast("string"), F.lit(")")), F.lit(""))) for name, index in parts]
    return F.concat_ws(":", *said)


def path_parts(path: Column) -> Column:
    """array<struct<name, idx>> of a path; idx is null where there is none."""
    return F.transform(
        F.split(path, ":"),
        lambda p: F.struct(F.regexp_extract(p, r"^([^(]*)", 1).alias("name"), F.regexp_extract(p, r"\((\d+)\)$", 1).try_cast("int").alias("idx")),
    )


def run_period(label: Column) -> Column:
    """Microseconds between software triggers for a rate such as ``100Hz``; a second if the rate is none of the known ones."""
    known = {"2000Hz": 500, "1000Hz": 1000, "120Hz": 8333, "100Hz": 10000, "10Hz": 100000, "1Hz": 1000000}
    out = F.lit(1000000)
    for text, period in known.items():
        out = F.when(label == text, period).otherwise(out)
    return out


def rce_index(slot: Column, bay: Column, element: Column) -> Column:
    return (slot - 1) * 8 + bay * 2 + F.when(element == 2, 1).otherwise(0)


def sign_extend(value: Column, bits: int) -> Column:
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def label_of(code: Column, labels: dict[int, str]) -> Column:
    """The label of a code; null for unknown ones."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), code)


def code_of(label: Column, labels: dict[int, str]) -> Column:
    pairs = [F.lit(x) for k, v in labels.items() for x in (v, k)]
    return F.try_element_at(F.create_map(*pairs), label)


def elapsed_ns(seconds_a: Column, ns_a: Column, seconds_b: Column, ns_b: Column) -> Column:
    """a - b of times in seconds and nanoseconds."""
    return (seconds_a - seconds_b) * 1_000_000_000 + (ns_a - ns_b)
