"""Queries through the entropy codec, and checksums."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywire.functions.scalars import floor_div
from tallywire.operators import codec as C
from tallywire.operators import waveforms as W
from tallywire.plans.register import query
from tallywire.sources.generators import noise
from tallywire.sources.views import WAVES, table, waves


def _arrays(spark, sf_dir):
    return W.transpose(waves(spark, sf_dir), ("vec_id",), "i")


@query(f"WITH {WAVES} SELECT vec_id, array_to_string(list(adc ORDER BY i), ',') AS adcs FROM waves GROUP BY vec_id")
def codec_roundtrip(spark, sf_dir):
    """Waveforms coded, put in packets of eight channels, taken out and decoded: the samples again."""
    blocks = C.encode(_arrays(spark, sf_dir)).withColumn("pkt", floor_div(F.col("vec_id"), 8))
    again = C.split_packets(C.compressed_packets(blocks, ("pkt",), "vec_id"), ("pkt",), "vec_id")
    return C.decode(again).select("vec_id", F.array_join("adcs", ",").alias("adcs"))


@query()
def codec_sizes(spark, sf_dir):
    """Bytes of each coded waveform beside its bare samples of 12 bits."""
    return C.encode(_arrays(spark, sf_dir)).select("vec_id", F.length("block").cast("long").alias("coded"), F.lit(96).cast("long").alias("bare"))


@query()
def packet_tables(spark, sf_dir):
    """Packets of eight channels: their bytes and the bit offsets of the channels."""
    blocks = C.encode(_arrays(spark, sf_dir)).withColumn("pkt", floor_div(F.col("vec_id"), 8))
    made = C.compressed_packets(blocks, ("pkt",), "vec_id")
    return made.select("pkt", F.length("payload").cast("long").alias("bytes"), F.array_join("toc", ",").alias("toc"))


@query("SELECT event_id FROM events WHERE event_id % 50 = 0")
def crc32_check(spark, sf_dir):
    """Payloads with the checksum that came along, every 50th of them damaged: those that fail."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("props").cast("binary").alias("payload"))
    sent = rows.withColumn("crc", F.crc32("payload")).withColumn("payload", F.when(F.col("event_id") % 50 == 0, F.concat("payload", F.lit(b"\0"))).otherwise(F.col("payload")))
    return sent.filter(F.crc32("payload") != F.col("crc")).select("event_id")


@query()
def prbs_noise(spark, sf_dir):
    return noise(spark, 16, 64).select("ch", F.array_join("noise", ",").alias("noise"))
