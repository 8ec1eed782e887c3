"""Packets as binaries: written from frames or channels by Spark expressions, checked and taken apart again.

Two layouts, both of little-endian words and closed by the two trailer words of a record:

* a copy packet: the words of its frames, one after another;
* a channel packet: blocks of samples, one for each channel, and zeros to a whole word; then the table of contents, which is the
  bit offsets of the blocks and of their end (32 bits each, to a whole word) and a word that tells channels, samples and its length.

A header record holds the six header words of a packet's first frame, and of later frames those that their frame before does not
predict: a mask of six bits and a frame of ten for each such frame, and the words themselves. It has room for ``MAX_EXCEPTIONS``
of them and tells how many there were.

A packet is bounded (1024 frames of 240 bytes at most), and is gathered whole; everything else is done within its row.

Defined cases: a packet of one frame has no exceptions; a damaged or short binary gives a row with ``sound`` false and nothing taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.functions.bits import EXCEPTION, TRAILER, compose, digits_of, field, lit, trailer_words, word_at
from tallywire.schema import FRAME_WORDS, MAX_EXCEPTIONS, TICKS_PER_SAMPLE, TRAILER_PATTERN

# Record types in the trailer, and layouts of the words that describe records.
COPY, COMPRESSED = 1, 2
TOC_TRAILER = {"format": (0, 4), "type": (4, 4), "n64": (8, 16), "layout": (24, 4), "samples": (28, 12), "channels": (40, 12)}
TOC_FORMAT, TOC_TYPE = 3, 2
RECORD_WORD = {"format": (0, 4), "type": (4, 4), "n64": (8, 16), "exceptions": (24, 8), "status": (32, 32)}
HEADER_FORMAT, HEADER_TYPE = 3, 1
#: Header words in the order of a mask's bits, with what a frame adds to each: ticks, or 1 to the convert count in the top 16 bits.
HEADERS = {"w0": None, "tick": "tick", "a0": "convert", "b0": None, "a1": "convert", "b1": None}
#: Bytes of the two words that close a packet.
CLOSING = 16


def _later(word: Column, kind: str | None, frames: Column) -> Column:
    """A header word so many frames later, as far as it can be told."""
    if kind == "tick":
        return word + TICKS_PER_SAMPLE * frames
    if kind == "convert":
        count = (F.shiftrightunsigned(word, 48) + frames).bitwiseAND(lit(0xFFFF))
        return F.shiftleft(count, 48).bitwiseOR(word.bitwiseAND(lit((1 << 48) - 1)))
    return word


def _closed(body: Column, status: Column, record_type: int, version: Column) -> Column:
    """The digits of a packet's words, with the trailer, as a binary."""
    nbytes = F.length(body) / 2 + CLOSING
    first, second = trailer_words(status, lit(0), lit(record_type), nbytes.cast("long"), version)
    return F.unhex(F.concat(body, digits_of(first), digits_of(second)))


def _read_closing(packets: DataFrame, record_type: int) -> DataFrame:
    """Adds status and sound: the trailer's own length, type and pattern are right."""
    size = F.octet_length("payload")
    closed = (size >= CLOSING) & (size % 8 == 0)
    taken = _made(packets, _first=F.when(closed, word_at(F.col("payload"), size - 16)), _second=F.when(closed, word_at(F.col("payload"), size - 8)))
    first, second = F.col("_first"), F.col("_second")
    right = (field(first, *TRAILER["nbytes"]) == size) & (field(first, *TRAILER["record_type"]) == record_type) & (field(second, 32, 32) == lit(TRAILER_PATTERN))
    right = F.coalesce(right, F.lit(False))
    return _made(taken, sound=right, status=F.when(right, field(first, *TRAILER["status"]))).drop("_first", "_second")


def _made(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are made once for a row, however often they are looked at: what a generator makes is not put in for its name."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_one")
    kept = [c for c in rows.columns if c not in columns]
    return rows.select("*", one).select(*kept, *[F.col(f"_one.{n}").alias(n) for n in columns])


def _whole(digits: Column) -> Column:
    """Digits and zeros, to a whole word."""
    return F.rpad(digits, (F.ceil(F.length(digits) / 16) * 16).cast("int"), F.lit("0"))


# ---- copy packets


def _in_bytes(rows: DataFrame, words: str, out: str) -> DataFrame:
    """A column of words (array<long>) as their bytes, last; nulls have none."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            flat, of = column.flatten(), pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
            if flat.null_count:
                of, flat = of[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
            ends = np.cumsum(np.append(0, 8 * np.bincount(of, minlength=batch.num_rows))).astype(np.int32)
            data = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False), dtype="<i8")
            made = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], out])

    others = [c for c in rows.columns if c != words]
    return rows.select(*others, words).mapInArrow(run, T.StructType([*[rows.schema[c] for c in others], T.StructField(out, T.BinaryType())]))


def _in_words(rows: DataFrame, data: str, out: str, n: int) -> DataFrame:
    """A column of binaries of ``n`` words each as arrays of long, last; null stays null."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            there = column.is_valid().to_numpy(zero_copy_only=False)
            flat = np.frombuffer(b"".join(column.drop_null().to_pylist()), dtype="<i8")
            begins = np.cumsum(np.append(0, n * there)).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(begins, mask=np.append(~there, False)), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], out])

    others = [c for c in rows.columns if c != data]
    schema = T.StructType([*[rows.schema[c] for c in others], T.StructField(out, T.ArrayType(T.LongType()))])
    return rows.select(*others, data).mapInArrow(run, schema)


def _joined(rows: DataFrame, parts: str, out: str) -> DataFrame:
    """A column of arrays of binaries as one binary each, last; null ones have no bytes. They lie one after another in a batch already."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            flat = column.values
            ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
            data = flat.buffers()[2] or pa.py_buffer(b"")
            made = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(np.ascontiguousarray(ends[column.offsets.to_numpy()])), data])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], out])

    others = [c for c in rows.columns if c != parts]
    return rows.select(*others, parts).mapInArrow(run, T.StructType([*[rows.schema[c] for c in others], T.StructField(out, T.BinaryType())]))


def copy_payloads(frames: DataFrame, *, key: str = "link", words: str = "words", version: int = 0x01000000) -> DataFrame:
    """(key, pkt, frames, payload): one binary of all frames (key, pkt, frame, status, words array<long>) of a packet."""
    rows = _in_bytes(frames.select(key, "pkt", "frame", "status", F.col(words).cast("array<long>").alias("words")), "words", "data")
    made = rows.groupBy(key, "pkt").agg(F.sort_array(F.collect_list(F.struct("frame", "data"))).alias("all"), F.bit_or("status").alias("status"))
    made = _joined(made.select(key, "pkt", F.size("all").cast("long").alias("frames"), "status", F.col("all.data").alias("data")), "data", "body")
    first, second = trailer_words(F.col("status"), lit(0), lit(COPY), (F.octet_length("body") + CLOSING).cast("long"), lit(version))
    return made.select(key, "pkt", "frames", F.concat("body", F.unhex(F.concat(digits_of(first), digits_of(second)))).alias("payload"))


def copied_frames(packets: DataFrame, *, n: int = FRAME_WORDS) -> DataFrame:
    """The frames of copy packets (payload and other columns): other columns, sound, status, frame and words; a packet that is not sound is one
    row without a frame."""
    whole = _read_closing(packets, COPY)
    count = F.call_function("div", (F.octet_length("payload") - CLOSING).cast("long"), lit(8 * n))
    fits = F.coalesce(F.col("sound") & (F.pmod(F.octet_length("payload") - CLOSING, F.lit(8 * n)) == 0) & (count > 0), F.lit(False))
    rows = _made(whole, sound=fits)
    pieces = F.transform(F.sequence(lit(0), count - 1), lambda i: F.substring("payload", (i * (8 * n) + 1).cast("int"), F.lit(8 * n)))
    others = [c for c in rows.columns if c != "payload"]
    rows = rows.select(*others, F.posexplode_outer(F.when(F.col("sound"), pieces)).alias("_frame", "_data"))
    return _in_words(rows.select(*others, F.col("_frame").cast("long").alias("frame"), "_data"), "_data", "words", n)


# ---- channel packets


def channel_payloads(blocks: DataFrame, *, keys: tuple[str, ...], channel: str = "ch", adcs: str = "adcs", version: int = 0x01000000) -> DataFrame:
    """(keys, channels, payload): one binary of the channels' samples (keys, channel, adcs array) and their table of contents: 16 bits
    a sample, the number of which may differ from channel to channel."""
    samples = F.array_join(F.transform(adcs, lambda a: digits_of(a, 2)), "")
    own = F.struct(F.col(channel).cast("long").alias("ch"), samples.alias("digits"), F.size(adcs).alias("n"))
    made = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(own)).alias("all"))
    n, ends = F.size("all"), F.aggregate("all", F.array(lit(0)), lambda s, b: F.concat(s, F.array(F.element_at(s, -1) + 4 * F.length(b["digits"]))))
    made = made.withColumn("offsets", ends)
    table = _whole(F.array_join(F.transform("offsets", lambda o: digits_of(o, 4)), ""))
    n64 = F.length(table) / 16 + 1
    # a channel may have any samples: the longest says how many
    longest = F.array_max(F.transform("all", lambda b: b["n"]))
    told = compose(a=(lit(TOC_FORMAT), 0), b=(lit(TOC_TYPE), 4), c=(n64, 8), d=(lit(0), 24), e=(longest - 1, 28), f=(n - 1, 40))
    body = F.concat(_whole(F.array_join(F.transform("all", lambda b: b["digits"]), "")), table, digits_of(told))
    return made.select(*keys, F.transform("all", lambda b: b["ch"]).alias("channels"), _closed(body, lit(0), COMPRESSED, lit(version)).alias("payload"))


def channel_blocks(packets: DataFrame, *, channels: str = "channels") -> DataFrame:
    """The samples of channel packets (payload, channels array and other columns): other columns, sound, ch and adcs. Offsets must rise and end
    where the table begins, or the packet is not sound and is one row without samples."""
    whole = _read_closing(packets, COMPRESSED)
    data, size = F.col("payload"), F.octet_length("payload")
    whole = _made(whole, _told=F.when(F.col("sound") & (size >= CLOSING + 8), word_at(data, size - CLOSING - 8)))
    told = lambda name: field(F.col("_told"), *TOC_TRAILER[name])
    whole = _made(whole, _start=size - CLOSING - 8 * told("n64"), _n=told("channels") + 1, _each=told("samples") + 1)
    right = (told("format") == TOC_FORMAT) & (told("type") == TOC_TYPE) & (F.col("_start") >= 0) & (F.size(channels) == F.col("_n")) & (told("n64") == F.ceil((F.col("_n") + 1) / 2) + 1)
    offsets = F.transform(F.sequence(lit(0), F.col("_n")), lambda i: word_at(data, F.col("_start") + 4 * i, 4))
    whole = _made(whole, _offsets=F.when(F.coalesce(right, F.lit(False)), offsets))
    rise = F.forall(F.sequence(lit(1), F.col("_n")), lambda i: F.get("_offsets", i.cast("int")) >= F.get("_offsets", (i - 1).cast("int")))
    ends = (F.get("_offsets", F.lit(0)) == 0) & (F.ceil(F.element_at("_offsets", -1) / 64) * 8 == F.col("_start"))
    whole = _made(whole, sound=F.when(F.col("_offsets").isNull(), F.lit(False)).otherwise(F.coalesce(rise & ends, F.lit(False))))
    rows = whole.withColumn("_i", F.explode_outer(F.when(F.col("sound"), F.sequence(lit(0), F.col("_n") - 1))))
    begin, end = (F.call_function("div", F.get("_offsets", (F.col("_i") + k).cast("int")), lit(8)) for k in (0, 1))
    held = F.when(F.col("_i").isNotNull(), F.least(F.col("_each"), F.call_function("div", end - begin, lit(2))))
    rows = _made(rows, _begin=begin, _held=held)
    adcs = F.transform(F.sequence(lit(0), F.col("_held") - 1), lambda i: word_at(data, F.col("_begin") + 2 * i, 2))
    adcs = F.when(F.col("_held") > 0, adcs).when(F.col("_held") == 0, F.array().cast("array<bigint>"))
    rows = rows.withColumn("ch", F.get(channels, F.col("_i").cast("int"))).withColumn("adcs", adcs)
    return rows.drop("payload", "status", channels, "_told", "_start", "_n", "_each", "_offsets", "_i", "_begin", "_held")


# ---- header records


def header_records(frames: DataFrame, *, key: str = "link", most: int = MAX_EXCEPTIONS) -> DataFrame:
    """(key, pkt, frames, record): the header record of each packet of frames (key, pkt, frame, status and the header words)."""
    before = Window.partitionBy(key, "pkt").orderBy("frame")
    words = [F.col(w) for w in HEADERS]
    off = [F.coalesce(F.col(w) != _later(F.lag(w).over(before), kind, lit(1)), F.lit(False)) for w, kind in HEADERS.items()]
    mask = compose(**{f"m{i}": (c.cast("int"), i) for i, c in enumerate(off)})
    rows = frames.select(key, "pkt", "frame", "status", *HEADERS, mask.alias("mask"))
    said = F.struct("frame", "mask", F.array(*words).alias("words"))
    made = rows.groupBy(key, "pkt").agg(
        F.count(F.lit(1)).alias("frames"), F.bit_or("status").alias("status"), F.min_by(F.array(*words), "frame").alias("first"), F.max_by("tick", "frame").alias("last_tick"),
        F.sort_array(F.collect_list(F.when(F.col("mask") != 0, said))).alias("found"),
    )
    kept = F.slice("found", 1, most)
    values = F.transform(F.flatten(F.transform(kept, lambda e: F.filter(e["words"], lambda _, i: F.call_function("shiftright", e["mask"], i).bitwiseAND(lit(1)) == 1))), lambda w: digits_of(w))
    entries = F.array_join(F.transform(kept, lambda e: digits_of(compose(frame=(e["frame"], EXCEPTION["frame"][0]), mask=(e["mask"], EXCEPTION["mask"][0])), 2)), "")
    entries = _whole(entries)
    body = F.concat(F.array_join(F.transform("first", lambda w: digits_of(w)), ""), digits_of(F.col("last_tick")), digits_of(F.col("frames")), F.array_join(values, ""), entries)
    head = compose(a=(lit(HEADER_FORMAT), 0), b=(lit(HEADER_TYPE), 4), c=(F.length(body) / 16 + 1, 8), d=(F.least(F.size("found"), F.lit(255)), 24), e=(F.col("status"), 32))
    return made.select(key, "pkt", "frames", F.unhex(F.concat(digits_of(head), body)).alias("record"))


def rebuilt_frames(records: DataFrame, *, most: int = MAX_EXCEPTIONS) -> DataFrame:
    """All header words of all frames of header records (record and other columns): other columns, frame, lost and the words. Each word is its
    own last kept value and what every frame since adds. Of a packet with more than ``most`` exceptions, frames behind the last
    kept one are lost: they have no words, as it is not known where the next exception was."""
    data, head = F.col("record"), word_at(F.col("record"), lit(0))
    part = lambda name: field(head, *RECORD_WORD[name])
    n = len(HEADERS)
    rows = _made(records, _found=part("exceptions"), _n64=part("n64"), _kept=F.least(part("exceptions"), lit(most)), _frames=word_at(data, lit(8 * (n + 2))))
    place = (F.col("_n64") - F.ceil(F.col("_kept") / 4)) * 8  # entries end the record
    entry = lambda i: word_at(data, place + 2 * i, 2)
    of = lambda i: F.struct(field(entry(i), *EXCEPTION["frame"]).alias("frame"), field(entry(i), *EXCEPTION["mask"]).alias("mask"))
    entries = F.when(F.col("_kept") > 0, F.transform(F.sequence(lit(0), F.col("_kept") - 1), of)).otherwise(F.array().cast("array<struct<frame:bigint,mask:bigint>>"))
    rows = _made(rows, _entries=entries)
    # where an exception's words begin: behind those of the exceptions before it
    counts = F.transform("_entries", lambda e: F.bit_count(e["mask"]).cast("long"))
    starts = F.aggregate(counts, F.array(lit(0)), lambda s, c: F.concat(s, F.array(F.element_at(s, -1) + c)))
    rows = _made(rows, _starts=starts)

    def known(w: int) -> Column:
        """Of word w, the frames at which it is told, and its values."""
        first = F.struct(lit(0).alias("frame"), word_at(data, lit(8 * (1 + w))).alias("value"))
        below = lambda e: F.bit_count(e["mask"].bitwiseAND(lit((1 << w) - 1))).cast("long")
        told = F.transform("_entries", lambda e, i: F.struct(e["frame"].alias("frame"), word_at(data, 8 * (lit(n + 3) + F.get("_starts", i) + below(e))).alias("value"), e["mask"].alias("mask")))
        told = F.transform(F.filter(told, lambda e: field(e["mask"], w, 1) == 1), lambda e: F.struct(e["frame"].alias("frame"), e["value"].alias("value")))
        return F.concat(F.array(first), told)

    rows = _made(rows, **{f"_w{w}": known(w) for w in range(n)})
    rows = rows.withColumn("frame", F.explode(F.sequence(lit(0), F.col("_frames") - 1)))
    lost = (F.col("_found") > most) & (F.col("frame") > F.get("_entries", F.size("_entries") - 1)["frame"])

    def at(w: int, kind: str | None) -> Column:
        last = F.element_at(F.filter(f"_w{w}", lambda k: k["frame"] <= F.col("frame")), -1)
        return F.when(~F.col("lost"), _later(last["value"], kind, F.col("frame") - last["frame"]))

    rows = _made(rows, lost=F.coalesce(lost, F.lit(False)))
    others = [c for c in records.columns if c != "record"]
    return rows.select(*others, "frame", "lost", *[at(w, kind).alias(name) for w, (name, kind) in enumerate(HEADERS.items())])
