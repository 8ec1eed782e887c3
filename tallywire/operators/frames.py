"""Validation, decoding and packetising of frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.bits import COLD_WORD0, COLD_WORD1, FRAME_HEADER, compose, field, lit
from tallywire.functions.scalars import floor_div
from tallywire.operators.ranges import carried, numbered, running_sum
from tallywire.schema import COMMA, FIRST_FRAME_MASKS, FRAME_WORDS, FRAMING_SHIFT, MAX_EXCEPTIONS, STATUS_BITS, TICKS_PER_SAMPLE, VERSION


def status(frames: DataFrame, *, first_mask: str = "as_written", key: str = "link", order: str = "k", counts: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Adds status to frames (w0, tick, a0, b0, a1, b1, sof_bits, eof_bits, eof_error, run_enable, flush).

    Each check compares a field with a constant, with the link's first frame, or with the frame before; the first frame
    of a link has none before it, and keeps the bits of ``first_mask`` only.

    ``counts`` are running counts over a link that later steps need, made on the way so that frames are dealt out once: of frames
    whose status has a property that run and framing bits alone decide, such as :func:`promoted`.
    """
    kept_columns, kept = frames.columns, FIRST_FRAME_MASKS[first_mask]
    marked = _word(_marks())
    counted = {n: has_it(marked).cast("int") for n, has_it in (counts or {}).items()}
    frames = carried(
        frames, key=key, order=(order,), sums=counted, previous={n: F.col(n) for n in ("tick", "a0", "b0", "a1", "b1")},
        first={"first_id": field(F.col("w0"), *FRAME_HEADER["id"])} | ({"first_marks": marked} if counted else {}),
    )
    for n, has_it in (counts or {}).items():  # of the first frame, the kept bits count
        as_kept = has_it(F.col("first_marks").bitwiseAND(lit(kept))).cast("long") - has_it(F.col("first_marks")).cast("long")
        frames = frames.withColumn(n, F.col(n) + as_kept)
    return status_of(frames, first_mask=first_mask).select(*[c for c in kept_columns if c != "status" and c not in counted], *counted, "status")


def _marks() -> dict[str, Column]:
    """The checks of a frame's run and framing bits."""
    return {"run_disable": ~F.col("run_enable"), "flush": F.col("flush"), **framing(F.col("sof_bits"), F.col("eof_bits")), "eof_error": F.col("eof_error")}


def status_of(frames: DataFrame, *, first_mask: str = "as_written") -> DataFrame:
    """Adds status to frames that have their context: ``prev``, the words of the frame before, and ``first_id``, the id of the first."""
    head = lambda name: field(F.col("w0"), *FRAME_HEADER[name])
    checks = {
        "bad_comma": head("comma") != COMMA,
        "bad_version": head("version") != VERSION,
        "bad_id": head("id") != F.col("first_id"),
        "bad_rsvd": F.lit(False),  # declared, never raised
        "bad_errors": head("errors") != 0,
        "bad_timestamp": F.col("tick") != F.col("prev.tick") + TICKS_PER_SAMPLE,
        **_marks(),
    }
    for n in (0, 1):
        a, b = F.col(f"a{n}"), F.col(f"b{n}")
        convert, hdrs = field(a, *COLD_WORD0["convert"]), field(b, *COLD_WORD1["hdrs"])
        convert_before, hdrs_before = field(F.col(f"prev.a{n}"), *COLD_WORD0["convert"]), field(F.col(f"prev.b{n}"), *COLD_WORD1["hdrs"])
        checks |= {
            f"cd{n}_stream_err1": field(a, *COLD_WORD0["stream_err1"]) != 0,
            f"cd{n}_stream_err2": field(a, *COLD_WORD0["stream_err2"]) != 0,
            f"cd{n}_rsvd0": field(a, *COLD_WORD0["rsvd0"]) != 0,
            f"cd{n}_convert": convert != (convert_before + 1).bitwiseAND(lit(0xFFFF)),
            f"cd{n}_err_reg": field(b, *COLD_WORD1["err_reg"]) != 0,
            f"cd{n}_rsvd1": field(b, *COLD_WORD1["rsvd1"]) != 0,
            f"cd{n}_hdrs": hdrs != hdrs_before,
        }
    word = _word(checks)
    return frames.withColumn("status", F.when(F.col("prev").isNull(), word.bitwiseAND(lit(FIRST_FRAME_MASKS[first_mask]))).otherwise(word))


def _word(checks: dict[str, Column]) -> Column:
    """The status bits of checks that are true."""
    word = lit(0)
    for name, check in checks.items():
        word = word.bitwiseOR(F.when(check, lit(1 << STATUS_BITS[name])).otherwise(lit(0)))
    return word


def framing(sof: Column, eof: Column, words: int = FRAME_WORDS) -> dict[str, Column]:
    """The checks of start and end marks, given as bits by word: a start at the first word alone, an end at the last alone."""
    last = 1 << (words - 1)
    return {
        "sof_missing": sof.bitwiseAND(lit(1)) == 0,
        "sof_unexpected": sof.bitwiseAND(lit(~1)) != 0,
        "eof_missing": eof.bitwiseAND(lit(last)) == 0,
        "eof_unexpected": eof.bitwiseAND(lit(~last)) != 0,
    }


def has(name: str) -> Column:
    return field(F.col("status"), STATUS_BITS[name], 1) == 1


def good(status: Column | None = None) -> Column:
    """No framing error of any kind."""
    return field(F.col("status") if status is None else status, FRAMING_SHIFT, 6) == 0


def failed(status: Column | None = None) -> Column:
    """A framing error of any kind."""
    return ~good(status)


def promoted(status: Column | None = None) -> Column:
    """Neither run-disabled nor a flush frame."""
    return field(F.col("status") if status is None else status, STATUS_BITS["run_disable"], 2) == 0


#: Groups of status bits: (first bit, bits).
BAD_GROUPS = {"header0": (0, 5), "timestamp": (5, 1), "cd0_word0": (8, 5), "cd0_word1": (13, 3), "cd1_word0": (16, 5), "cd1_word1": (21, 3)}


def bad_groups() -> Column:
    """Six bits, one for each group of checks that found anything: an exception's mask. The status is made once for all six: its
    checks six times over are more code than a method may hold."""
    mask = lambda status: compose(**{name: (F.when(field(status, *at) != 0, 1).otherwise(0), i) for i, (name, at) in enumerate(BAD_GROUPS.items())})
    return F.transform(F.array("status"), mask)[0]


def exceptions(frames: DataFrame, frames_per_packet: int, *, most: int = MAX_EXCEPTIONS, key: str = "link", order: str = "k") -> DataFrame:
    """(key, pkt, frame, mask): the first ``most`` frames of each packet with any bad header."""
    rows = frames.withColumn("pkt", floor_div(F.col(order), frames_per_packet)).withColumn("mask", bad_groups()).filter("mask <> 0")
    rank = F.row_number().over(Window.partitionBy(key, "pkt").orderBy(order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= most).select(key, "pkt", (F.col(order) % frames_per_packet).alias("frame"), "mask")


def packetise(frames: DataFrame, frames_per_packet: int, *, key: str = "link", order: str = "k", number: str | None = None) -> DataFrame:
    """Adds pkt and frame to promoted frames, by their running number: dropped frames take no place.

    ``number`` names a running count of promoted frames that is there already, such as a count of :func:`status`."""
    kept = frames.filter(promoted())
    kept = numbered(kept, out="_n", key=key, order=(order,)) if number is None else kept.withColumn("_n", F.col(number) - 1)
    return kept.withColumn("pkt", floor_div(F.col("_n"), frames_per_packet)).withColumn("frame", F.col("_n") % frames_per_packet).drop("_n", *([number] if number else []))


def write_counters(frames: DataFrame, frames_per_packet: int, *, words: int = FRAME_WORDS, key: str = "link", number: str = "written") -> DataFrame:
    """Counters of a writer: packets, bytes, the last and the largest packet's bytes, dropped frames; links with packets only. One grouping
    by packet, in which the dropped frames of a link are a group of their own, then one by link."""
    pkt = F.when(promoted(), floor_div(F.col(number) - 1, frames_per_packet)).alias("pkt")
    counted = frames.groupBy(key, pkt).agg(F.count(F.lit(1)).alias("n"))
    nbytes = F.when(F.col("pkt").isNotNull(), F.col("n") * 8 * words + 16)
    sums = counted.groupBy(key).agg(
        F.count("pkt").alias("packets"), F.sum(nbytes).alias("bytes"), F.max_by(nbytes, "pkt").alias("last_bytes"), F.max(nbytes).alias("max_bytes"),
        F.coalesce(F.max(F.when(F.col("pkt").isNull(), F.col("n"))), F.lit(0)).alias("dropped"),
    )
    return sums.filter("packets > 0")


def packet_summary(packets: DataFrame, *, key: str = "link") -> DataFrame:
    """Of each packet: frames, first and last tick, first header words, OR of all status words."""
    first = lambda c: F.min_by(c, "frame")
    return packets.groupBy(key, "pkt").agg(
        F.count(F.lit(1)).alias("frames"), first("tick").alias("first_tick"), F.max_by("tick", "frame").alias("last_tick"),
        *[first(c).alias(f"first_{c}") for c in ("w0", "a0", "b0", "a1", "b1")], F.bit_or("status").alias("status"),
    )


def counters(frames: DataFrame, *, key: str = "link") -> DataFrame:
    """Counters of a reader: frames by state, framing errors, header errors.

    A frame without its start counts as that alone; states count for good frames; header errors for good frames that
    are no flush.
    """
    state = field(F.col("status"), STATUS_BITS["run_disable"], 2)
    sound = good() & ~has("flush")
    out = [F.count(F.lit(1)).alias("frames")]
    out += [F.count_if(good() & (state == s)).alias(name) for s, name in enumerate(("normal", "disabled", "flushed", "disabled_flushed"))]
    out += [F.count_if(has("sof_missing")).alias("sof_missing")]
    out += [F.count_if(~has("sof_missing") & has(name)).alias(name) for name in ("sof_unexpected", "eof_missing", "eof_unexpected", "eof_error")]
    out += [F.count_if(sound & has(name)).alias(name) for name in STATUS_BITS if STATUS_BITS[name] < 24]
    return frames.groupBy(key).agg(*out)


def rebuild_headers(exceptions: DataFrame, *, key: str = "link", order: str = "k") -> DataFrame:
    """Ticks, and convert counts if there are any, of frames of which only unexpected ones are kept (others null): the last kept
    value and 25, or 1 modulo 65536, for each frame since. Last kept values are carried over ranges; rows are dealt out once."""
    made = {"tick": ("rebuilt", TICKS_PER_SAMPLE, 63), "convert": ("rebuilt_convert", 1, 16)}
    there = [c for c in made if c in exceptions.columns]
    out = carried(exceptions, key=key, order=(order,), known={f"_{c}": F.col(c) for c in there})
    for c in there:
        name, step, bits = made[c]
        out = out.withColumn(name, (F.col(f"_{c}.value") + step * (F.col(order) - F.col(f"_{c}.at"))).bitwiseAND(lit((1 << bits) - 1)))
    return out.drop(*[f"_{c}" for c in there])


def until_errors(frames: DataFrame, most: int, failed: Column, *, key: str = "link", order: str = "k", total: str | None = None) -> DataFrame:
    """Frames up to a link's error number ``most``, with it: a reader stops there. ``total`` names a running count of errors that is there
    already."""
    rows = frames if total else running_sum(frames, failed.cast("long"), out="_errors", key=key, order=(order,))
    return rows.filter(F.col(total or "_errors") - F.coalesce(failed.cast("long"), lit(0)) < most).drop(total or "_errors")


def frame_symbols(symbols: DataFrame, *, key: str = "lane", order: str = "pos") -> DataFrame:
    """Adds frame: the number of start symbols so far. Symbols before the first start belong to frame 0."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return symbols.withColumn("frame", F.sum(F.col("is_start").cast("long")).over(w))


def next_marker(words: DataFrame, *, key: str = "lane", order: str = "pos") -> DataFrame:
    """Adds resync: the position of the next marker after each word, null if none follows."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return words.withColumn("resync", F.min(F.when(F.col("is_marker"), F.col(order))).over(w))


def captures(symbols: DataFrame, length: int, *, key: str = "lane", order: str = "pos") -> DataFrame:
    """Words captured after each marker: up to ``length``, or to the next control word; (key, capture, i, order)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = symbols.withColumn("capture", F.sum(F.col("is_marker").cast("long")).over(w)).filter("capture > 0")
    inner = Window.partitionBy(key, "capture").orderBy(order)
    placed = marked.withColumn("i", F.row_number().over(inner) - 1).withColumn("closed", F.sum((F.col("is_control") & ~F.col("is_marker")).cast("int")).over(inner))
    return placed.filter((F.col("i") >= 1) & (F.col("i") <= length) & (F.col("closed") == 0)).select(key, "capture", F.col("i").cast("long").alias("i"), order)


def mismatches(expected: DataFrame, actual: DataFrame, *, keys: tuple[str, ...] = ("link", "k"), value: str = "word") -> DataFrame:
    """Words that differ between two streams, or stand in one only: (keys, expected, actual)."""
    a, b = expected.select(*keys, F.col(value).alias("expected")), actual.select(*keys, F.col(value).alias("actual"))
    return a.join(b, list(keys), "full_outer").filter(~F.col("expected").eqNullSafe(F.col("actual")))
