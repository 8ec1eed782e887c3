"""Queries through binary files: written by tasks, read back by byte ranges, decoded."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywire.functions.bits import swapped
from tallywire.operators.waveforms import transpose
from tallywire.plans.register import query
from tallywire.schema import TRAILER_PATTERN
from tallywire.sources import binary
from tallywire.sources.decoders import decoded, decoders
from tallywire.sources.files import write_bytes
from tallywire.sources.folders import shared_root
from tallywire.sources.resync import read_slices
from tallywire.sources.views import table, waves


@query("""SELECT user_id % 2048 AS id, 1000000 + 25 * event_id AS tick, (event_id + 256) & 65535 AS convert0, (event_id + 256) & 65535 AS convert1, adcs[1:64] = f0 AS first, adcs[65:128] = f1 AS second,
    CAST(list_sum(adcs) AS BIGINT) AS total FROM (SELECT *, [(event_id * 31 + i * 7) % 4096 for i in range(128)] AS adcs, [(event_id * 31 + i * 7) % 4096 for i in range(64)] AS f0, [(event_id * 31 + i * 7) % 4096 for i in range(64, 128)] AS f1 FROM events)""")
def frames_from_files(spark, sf_dir):
    """Whole frames of 128 samples each: composed, written as files, read by ranges and decoded; all samples are where they were."""
    number = F.col("event_id")
    sample = lambda i, e: (e * 31 + i * 7) % 4096
    adcs = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: sample(i, number))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", adcs.alias("adcs"))
    path = shared_root(spark, "frames")
    binary.write_frames(binary.create_frames(rows, source=F.col("user_id") % 2048, tick=1_000_000 + 25 * number, number=number), path)
    read = binary.decode_frames(binary.read_frames(spark, path, split=1 << 20))
    event = F.call_function("div", F.col("tick") - 1_000_000, F.lit(25).cast("long"))
    side = lambda n: F.forall(F.transform(F.col("streams")[n]["adcs"], lambda a, i: a == sample(i + 64 * n, event)), lambda x: x)
    total = F.aggregate(F.concat(F.col("streams")[0]["adcs"], F.col("streams")[1]["adcs"]), F.lit(0).cast("long"), lambda s, x: s + x)
    converts = [F.col("streams")[n]["convert"].alias(f"convert{n}") for n in (0, 1)]
    return read.select("id", "tick", *converts, side(0).alias("first"), side(1).alias("second"), total.alias("total"))


@query("""WITH w AS (SELECT vec_id, i - 1 AS i, CAST(floor(2048 + 1000 * CAST(x AS DOUBLE)) AS BIGINT) AS adc FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))
    SELECT CAST(i % 8 AS INTEGER) AS ch, array_to_string(list(adc ORDER BY i), ',') AS adcs FROM w GROUP BY vec_id, i % 8""")
def samples_from_files(spark, sf_dir):
    """Waveforms as packets of eight samples of eight channels: dumped time-major, read by ranges, turned channel-major."""
    path = shared_root(spark, "samples")
    binary.write_samples(transpose(waves(spark, sf_dir), ("vec_id",), "i"), path, samples=8, channels=8)
    return binary.read_samples(spark, path, samples=8, channels=8, split=1 << 16).select("ch", F.array_join("adcs", ",").alias("adcs"))


@query("""SELECT event_id AS sequence, user_id AS second, CAST(length(event_type) AS BIGINT) AS type, CASE WHEN event_id % 97 = 0 THEN 'damaged' ELSE 'record' END AS kind,
    CASE WHEN event_id % 97 = 0 THEN 2147483648 + event_id ELSE 20 + (strlen(props) + 3) // 4 * 4 END AS size, CASE WHEN event_id % 97 <> 0 THEN md5(props) END AS body FROM events""")
def resync_records(spark, sf_dir):
    """A stream of records, some of whose sizes are damaged: read in blocks as a sequential reader would, which goes on at the marker."""
    little = lambda v: F.unhex(swapped(F.lpad(F.hex(v.cast("long")), 8, "0"), 4))
    props = F.encode("props", "UTF-8")
    body = F.concat(props, F.substring(F.lit(b"\0\0\0"), F.lit(1), F.pmod(-F.length(props), F.lit(4))))
    size = F.when(F.col("event_id") % 97 == 0, F.lit(1 << 31) + F.col("event_id")).otherwise(F.length(body) + 20)
    head = [little(x) for x in (size, F.col("event_id"), F.col("user_id"), F.length("event_type"))]
    path = shared_root(spark, "slices")
    write_bytes(table(spark, sf_dir, "events").select(F.concat(*head, body, little(F.lit(TRAILER_PATTERN))).alias("data")), path)
    text = F.rtrim(F.decode(F.substring("data", F.lit(17), F.col("size").cast("int") - 20), "UTF-8"), F.lit("\0"))
    return read_slices(spark, path, block=1 << 18).select("sequence", "second", "type", "kind", "size", F.when(F.col("kind") == "record", F.md5(F.encode(text, "UTF-8"))).alias("body"))


def record_bytes(kind, payload):
    """A record as a file holds it: a 32-bit size with the type in its top four bits, then the payload."""
    size = F.octet_length(payload).cast("long").bitwiseOR(F.shiftleft(kind.cast("long"), 28))
    return F.concat(F.unhex(swapped(F.lpad(F.hex(size), 8, "0"), 4)), payload)


def _props(payload: bytes):
    """Of a JSON payload, its fields."""
    import json

    return ((name, json.dumps(value) if isinstance(value, (dict, list)) else value) for name, value in json.loads(payload).items())


def _user(payload: bytes):
    """Of two little-endian numbers, each by its name."""
    import struct

    return zip(("user", "event"), struct.unpack("<qq", payload), strict=True)


@query("""SELECT event_id, 'event' AS name, CAST(event_id AS VARCHAR) AS value FROM events WHERE event_id % 2 = 1 UNION ALL SELECT event_id, 'user', CAST(user_id AS VARCHAR) FROM events WHERE event_id % 2 = 1
    UNION ALL SELECT event_id, k AS name, props ->> k AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE event_id % 2 = 0)""")
def decoded_records(spark, sf_dir):
    """Records of two types, written to files, read and decoded by a decoder of the user's for each, in one query."""
    swap = lambda x: F.unhex(swapped(F.lpad(F.hex(x.cast("long")), 16, "0"), 8))
    even = F.col("event_id") % 2 == 0
    payload = F.when(even, F.encode("props", "UTF-8")).otherwise(F.concat(swap(F.col("user_id")), swap(F.col("event_id"))))
    # a record before each says whose it is
    rows = table(spark, sf_dir, "events").select("event_id", F.when(even, 1).otherwise(2).alias("type"), payload.alias("payload"))
    path = shared_root(spark, "records")
    write_bytes(rows.select(record_bytes(F.col("type"), F.concat(swap(F.col("event_id")), F.col("payload"))).alias("data")), path)
    read = binary.read_records(spark, path)
    number = F.conv(swapped(F.hex(F.substring("payload", 1, 8)), 8), 16, -10).cast("long")
    records = read.select(number.alias("event_id"), "type", F.expr("substring(payload, 9)").alias("payload"))
    return decoded(records, decoders(spark, {1: _props, 2: _user}), keep=["event_id"])
