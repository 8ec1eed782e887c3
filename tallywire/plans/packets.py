"""Queries over packets as binaries: payloads written, checked and taken apart, headers rebuilt."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywire.operators import frames as O
from tallywire.operators import packets as P
from tallywire.operators.waveforms import transpose
from tallywire.plans.frames import KEPT, STATUS, checked, kept
from tallywire.plans.register import query
from tallywire.schema import MAX_EXCEPTIONS, TRAILER_PATTERN
from tallywire.sources.views import SAMPLES, samples

#: Frames of a packet whose headers are rebuilt: enough for more exceptions than a record holds.
HEADER_PACKET = 96


def _with_words(rows):
    """Frames with all their words; those of the samples follow from the event's number."""
    body = lambda n: [(F.col("event_id") * 1000003 + 7919 * (n + i)).cast("long") for i in range(12)]
    return rows.withColumn("words", F.array("w0", "tick", "a0", "b0", *body(0), "a1", "b1", *body(12)))


def _le(word: str, n: int = 8) -> str:
    """SQL of a word's digits, least byte first."""
    return " || ".join(f"substr(printf('%0{2 * n}X', {word}), {2 * i + 1}, 2)" for i in range(n - 1, -1, -1))


_BODY = ", ".join(f"event_id * 1000003 + {7919 * i}" for i in range(12)), ", ".join(f"event_id * 1000003 + {7919 * (12 + i)}" for i in range(12))
WORDS = f"""{KEPT}, words AS (SELECT link, pkt, frame, status, unnest([w0, tick, a0, b0, {_BODY[0]}, a1, b1, {_BODY[1]}]) AS w, unnest(range(30)) AS i FROM kept),
bodies AS (SELECT link, pkt, count(DISTINCT frame) AS frames, bit_or(status) AS status, string_agg({_le('w')}, '' ORDER BY frame, i) AS body FROM words GROUP BY link, pkt)"""


@query(f"""WITH {WORDS} SELECT link, pkt, frames, frames * 240 + 16 AS nbytes, md5(body || {_le('CAST((frames * 240 + 16) | (1 << 24) | (CAST(status AS BIGINT) << 32) AS BIGINT)')} || {_le(f'CAST(16777216 | (CAST({TRAILER_PATTERN} AS BIGINT) << 32) AS BIGINT)')}) AS digest FROM bodies""")
def packet_payload(spark, sf_dir):
    """Copy packets: all words of their frames and the trailer in one binary."""
    made = P.copy_payloads(_with_words(kept(spark, sf_dir)))
    return made.select("link", "pkt", "frames", F.octet_length("payload").cast("long").alias("nbytes"), F.md5(F.hex("payload")).alias("digest"))


@query(f"""WITH {WORDS}, every AS (SELECT link, pkt, bit_or(status) AS status FROM kept GROUP BY link, pkt)
    SELECT link, pkt, frame, true AS sound, e.status, array_to_string(list(w ORDER BY i), ',') AS words FROM words JOIN every e USING (link, pkt) GROUP BY link, pkt, frame, e.status""")
def packet_decode(spark, sf_dir):
    """Copy packets taken apart: trailer and length checked, every word of every frame back."""
    made = P.copied_frames(P.copy_payloads(_with_words(kept(spark, sf_dir))).select("link", "pkt", "payload"))
    return made.select("link", "pkt", "frame", "sound", "status", F.array_join("words", ",").alias("words"))


@query(f"WITH {SAMPLES} SELECT pkt, ch, true AS sound, array_to_string(list(adc ORDER BY seq), ',') AS adcs FROM samples GROUP BY ch, pkt")
def packet_channels(spark, sf_dir):
    """Packets of eight channels with a table of contents, taken apart by its offsets."""
    blocks = transpose(samples(spark, sf_dir).select("ch", "pkt", "seq", "adc"), ("ch", "pkt"), "seq")
    group = F.call_function("div", F.col("ch"), F.lit(8).cast("long")).alias("grp")
    made = P.channel_payloads(blocks.select("*", group), keys=("grp", "pkt"))
    return P.channel_blocks(made).select("pkt", "ch", "sound", F.array_join("adcs", ",").alias("adcs"))


_PLAIN = ~(0xFFFFFFFF << 16)
_SAME = " OR ".join(
    f"{w} <> {('lag({w}) OVER p' if kind is None else 'lag({w}) OVER p + 25' if kind == 'tick' else '((((lag({w}) OVER p >> 48) & 65535) + 1) & 65535) << 48 | (lag({w}) OVER p & 281474976710655)').format(w=w)}"
    for w, kind in P.HEADERS.items()
)


@query(f"""WITH {STATUS}, kept AS (SELECT link, w0, tick, a0 & {_PLAIN} AS a0, b0, a1 & {_PLAIN} AS a1, b1, n // {HEADER_PACKET} AS pkt, n % {HEADER_PACKET} AS frame FROM (
        SELECT *, row_number() OVER (PARTITION BY link ORDER BY k) - 1 AS n FROM checked WHERE (status >> 24) & 3 = 0)),
    found AS (SELECT *, CAST(coalesce({_SAME}, false) AS INTEGER) AS off FROM kept WINDOW p AS (PARTITION BY link, pkt ORDER BY frame)),
    told AS (SELECT *, sum(off) OVER (PARTITION BY link, pkt) > {MAX_EXCEPTIONS} AND coalesce(sum(off) OVER (PARTITION BY link, pkt ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= {MAX_EXCEPTIONS} AS lost FROM found)
    SELECT link, pkt, frame, lost, {", ".join(f"CASE WHEN NOT lost THEN {w} END AS {w}" for w in P.HEADERS)} FROM told""")
def rebuild_frames(spark, sf_dir):
    """All header words of all frames, from the first frame's and those that no frame before predicts; what is lost with too many of these
    is said to be. (Checksums, which nothing predicts, are left out.)"""
    plain = lambda w: F.col(w).bitwiseAND(F.lit(_PLAIN).cast("long"))
    rows = O.packetise(checked(spark, sf_dir, written=O.promoted), HEADER_PACKET, number="written")
    records = P.header_records(rows.withColumn("a0", plain("a0")).withColumn("a1", plain("a1")))
    return P.rebuilt_frames(records.select("link", "pkt", "record"))
