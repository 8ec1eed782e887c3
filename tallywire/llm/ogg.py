"""Ogg media columns: bytes stored as 8-bit samples in a multiplexed Ogg file, and read back.

A file has two logical streams. One carries the samples: a head packet (format, rate, block size), then packets of
some blocks each, which run over page ends as lacing demands. The other carries one note packet with the number of
bytes before padding. Readers verify every page's checksum, put packets together from lacing values, keep the streams
apart by serial number, and place packets in time from the granule positions at page ends.

Defined cases: a null payload is an empty one and is stored as one padded block; a page whose checksum fails is
skipped, counted in ``bad_pages``, and the packets it touches are lost; a null media value reads as null columns; equal
payloads give equal files, whatever their rows; extra columns are ignored and an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.llm.arrow import id_type, map_steps, narrow

BLOCK = 576
PAD = 255
RATE = 8000
#: Blocks in a packet: eight of them take 19 lacing values, so packets do not end where pages do.
PACKET_BLOCKS = 8
SAMPLES, NOTES = b"PCMU8   ", b"NOTES   "
CONTINUED, FIRST, LAST = 1, 2, 4
NO_PACKET_ENDS = -1

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, most significant bit first, from 0: the mirror image of zlib's."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


class Page(NamedTuple):
    flags: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: bytes
    sound: bool


def page_bytes(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqII", b"OggS", 0, flags, granule, serial, number)
    rest = bytes([len(lacing)]) + lacing + body
    return head + struct.pack("<I", checksum(head + b"\0\0\0\0" + rest)) + rest


def stream_pages(serial: int, packets: list[bytes], ends: list[int]) -> list[bytes]:
    """Pages of one logical stream: its first packet alone, the others 255 lacing values a page. ``ends``: granule
    position after each packet."""
    out = [page_bytes(FIRST | (LAST if len(packets) == 1 else 0), ends[0], serial, 0, *_laced(packets[0]))]
    lacing, body = bytearray(), bytearray()
    granule, continued = NO_PACKET_ENDS, False

    def close(last: bool, goes_on: bool) -> None:
        nonlocal lacing, body, granule, continued
        out.append(page_bytes((CONTINUED if continued else 0) | (LAST if last else 0), granule, serial, len(out), bytes(lacing), bytes(body)))
        lacing, body, granule, continued = bytearray(), bytearray(), NO_PACKET_ENDS, goes_on

    for packet, end in zip(packets[1:], ends[1:], strict=True):
        values, at = len(packet) // 255 + 1, 0
        while values:
            if len(lacing) == 255:
                close(False, at > 0)
            fit = min(values, 255 - len(lacing))
            values -= fit
            part = packet[at : at + 255 * fit]
            at += len(part)
            lacing += b"\xff" * (fit - (not values)) + (b"" if values else bytes([len(packet) % 255]))
            body += part
        granule = end
    if lacing:
        close(True, False)
    return out


def _laced(packet: bytes) -> tuple[bytes, bytes]:
    return b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255]), packet


def store_bytes(data: bytes) -> bytes:
    """A file that holds the data, padded with 255 to a positive multiple of a block, as samples."""
    padded = data + bytes([PAD]) * (-len(data) % BLOCK if data else BLOCK)
    serial = zlib.crc32(data) & 0xFFFFFFFE
    size = BLOCK * PACKET_BLOCKS
    packets = [SAMPLES + struct.pack("<IH", RATE, BLOCK)] + [padded[i : i + size] for i in range(0, len(padded), size)]
    ends = [0, *np.cumsum([len(p) for p in packets[1:]]).tolist()]
    notes = stream_pages(serial | 1, [NOTES, struct.pack("<Q", len(data))], [0, 0])
    sound = stream_pages(serial, packets, ends)
    return b"".join([sound[0], notes[0], *sound[1:2], *notes[1:], *sound[2:]])


def read_pages(media: bytes) -> Iterator[Page]:
    at = 0
    while (at := media.find(b"OggS", at)) >= 0:
        if at + 27 > len(media):
            return
        _, version, flags, granule, serial, number, crc, n = struct.unpack_from("<4sBBqIIIB", media, at)
        lacing = media[at + 27 : at + 27 + n]
        stop = at + 27 + n + sum(lacing)
        page = media[at:stop]
        sound = len(lacing) == n and stop <= len(media) and version == 0 and checksum(page[:22] + b"\0\0\0\0" + page[26:]) == crc
        yield Page(flags, granule, serial, number, lacing, media[at + 27 + n : stop], sound)
        at = stop if sound else at + 4


class Packet(NamedTuple):
    serial: int
    data: bytes
    begin: int | None  # granule positions; None in streams whose packets tell no length, but for the end of a page's last
    end: int | None


def demultiplex(media: bytes) -> tuple[dict[int, list[Packet]], int]:
    """Packets of each logical stream, and the number of pages whose checksum failed."""
    streams: dict[int, list[Packet]] = {}
    open_parts: dict[int, list[bytes] | None] = {}
    numbers: dict[int, int] = {}
    bad = 0
    for page in read_pages(media):
        if not page.sound:
            bad += 1
            continue
        packets = streams.setdefault(page.serial, [])
        parts = open_parts.get(page.serial)
        if page.number != numbers.get(page.serial, -1) + 1 or bool(page.flags & CONTINUED) != bool(parts):
            parts = None  # what was open is lost, and so is what this page goes on with
        elif parts is None:
            parts = []
        numbers[page.serial] = page.number
        done, at, begin = [], 0, 0
        skip = bool(page.flags & CONTINUED) and not parts
        parts = parts or []
        for value in page.lacing:
            at += value
            if value < 255:
                if not skip:
                    done.append(b"".join([*parts, page.body[begin:at]]))
                parts, begin, skip = [], at, False
        if begin < at and not skip:
            parts.append(page.body[begin:at])
        open_parts[page.serial] = parts
        # the page tells where its last packet ends; the others end where the next begins, if their lengths in time are
        # known: those of samples are, once the head packet has told the stream's kind
        end: int | None = page.granule if page.granule != NO_PACKET_ENDS else None
        placed = []
        for i, data in reversed(list(enumerate(done))):
            head = not packets and not i
            sampled = packets[0].data.startswith(SAMPLES) if packets else done[0].startswith(SAMPLES)
            samples = 0 if head else len(data) if sampled else None
            begin = None if end is None or samples is None else end - samples
            placed.append(Packet(page.serial, data, begin, end))
            end = begin
        packets += reversed(placed)
    return streams, bad


class Content(NamedTuple):
    samples: bytes
    length: int | None  # bytes before padding
    bad: int  # pages whose checksum failed
    begin: int | None  # granule positions of the first sample and behind the last
    end: int | None


def read_bytes(media: bytes) -> Content:
    """What a file holds, in samples and in time."""
    streams, bad = demultiplex(media)
    samples, length, begin, end = b"", None, None, None
    for packets in streams.values():
        if packets and packets[0].data.startswith(SAMPLES):
            samples = b"".join(p.data for p in packets[1:])
            if len(packets) > 1:
                begin, end = packets[1].begin, packets[-1].end
        elif packets and packets[0].data == NOTES and len(packets) > 1:
            (length,) = struct.unpack("<Q", packets[1].data)
    return Content(samples, length, bad, begin, end)


def features(samples: bytes, begin: int | None = None, end: int | None = None, rate: int = RATE) -> str:
    """Duration in ms by granule positions (by the number of samples, if there are none), mean, mean square about 128 and its zero crossings, and the peak of each of eight equal parts."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64) - 128
    if not len(x):
        return "0"
    crossings = int(np.count_nonzero(np.diff(x >= 0)))
    peaks = [int(np.abs(part).max()) if len(part) else 0 for part in np.array_split(x, 8)]
    return ",".join(map(str, [(len(x) if begin is None or end is None else end - begin) * 1000 // rate, int(x.sum()) // len(x), int((x * x).sum()) // len(x), crossings, *peaks]))


def store(df: DataFrame, *, id_col: str = "doc_id", data_col: str = "text") -> DataFrame:
    """Each row's bytes (a text as UTF-8) as an Ogg file: the id column, media."""
    frame = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{data_col}`").cast("binary").alias("data"))
    schema = T.StructType([T.StructField(id_col, id_type(df, id_col)), T.StructField("media", T.BinaryType())])
    return map_steps(frame, lambda ids, data: {id_col: ids, "media": [store_bytes(x or b"") for x in data]}, schema)


def read(df: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The id column, media, payload (padded), n_bytes (before padding), bad_pages, begin_granule and end_granule (of the
    samples, from the pages' granule positions), feature."""
    schema = T.StructType(
        [T.StructField(id_col, id_type(df, id_col)), T.StructField("media", T.BinaryType()), T.StructField("payload", T.BinaryType())]
        + [T.StructField("n_bytes", T.LongType()), T.StructField("bad_pages", T.LongType())]
        + [T.StructField("begin_granule", T.LongType()), T.StructField("end_granule", T.LongType()), T.StructField("feature", T.StringType())]
    )

    def work(ids, media):
        got = [Content(None, None, None, None, None) if m is None else read_bytes(m) for m in media]
        return {
            id_col: ids,
            "media": media,
            "payload": [g.samples for g in got],
            "n_bytes": [g.length for g in got],
            "bad_pages": [g.bad for g in got],
            "begin_granule": [g.begin for g in got],
            "end_granule": [g.end for g in got],
            "feature": [None if g.samples is None else features(g.samples, g.begin, g.end) for g in got],
        }

    return map_steps(narrow(df, id=id_col, media=media_col), work, schema)


def packets(df: DataFrame, *, id_col: str = "doc_id", media_col: str = "media", rate: int = RATE) -> DataFrame:
    """A row per packet: the id column, serial, packet, begin_s and end_s (from granule positions; null where they do not
    tell), data. Null media give no rows."""
    schema = T.StructType(
        [T.StructField(id_col, id_type(df, id_col)), T.StructField("serial", T.LongType()), T.StructField("packet", T.LongType())]
        + [T.StructField("begin_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("data", T.BinaryType())]
    )

    def work(ids, media):
        seconds = lambda granule: None if granule is None else granule / rate
        rows = [
            (key, serial, k, seconds(p.begin), seconds(p.end), p.data)
            for key, m in zip(ids, media, strict=True)
            if m is not None
            for serial, found in demultiplex(m)[0].items()
            for k, p in enumerate(found)
        ]
        return dict(zip(schema.names, zip(*rows, strict=True), strict=True)) if rows else None

    return map_steps(narrow(df, id=id_col, media=media_col), work, schema)


def op5_ogg(spark, sf_dir: str) -> DataFrame:
    stored = store(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "bad_pages",
        "begin_granule",
        "end_granule",
    )
