"""The tables of a scale folder, read as detector data and telemetry.

Every view has a SQL twin, a common table expression of the same name, for the queries' SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywire.functions.bits import compose
from tallywire.functions.scalars import floor_div
from tallywire.operators.ranges import numbered
from tallywire.schema import COMMA, FRAME_WORDS, TICKS_PER_SAMPLE

#: Samples in a packet of the sample view.
PACKET = 64
#: Links that the frame view deals events to, and frames in its packets.
LINKS, FRAMES_PER_PACKET = 8, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ch, seq, pkt, adc, ts, event_id): a user's events as the samples of a channel."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seq = F.row_number().over(w).cast("long") - 1
    return (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").alias("ch"), seq.alias("seq"), F.floor(F.col("value") / 8).cast("long").alias("adc"), "ts", "event_id")
        .withColumn("pkt", floor_div(F.col("seq"), PACKET))
    )


SAMPLES = f"""samples AS (
    SELECT *, seq // {PACKET} AS pkt FROM (
        SELECT user_id AS ch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
            CAST(floor(value / 8) AS BIGINT) AS adc, ts, event_id FROM events)
)"""


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, i, adc): an embedding as a waveform about the pedestal."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.floor(2048 + 1000 * F.col("x").cast("double")).cast("long").alias("adc"))


WAVES = """waves AS (
    SELECT vec_id, CAST(i - 1 AS BIGINT) AS i, CAST(floor(2048 + 1000 * CAST(x AS DOUBLE)) AS BIGINT) AS adc
    FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(link, k, event_id, w0, tick, a0, b0, a1, b1, sof_bits, eof_bits, eof_error, run_enable, flush): events as frame headers, some of
    them broken by a rule on the event's number. sof_bits and eof_bits tell at which of a frame's words the marks stand.
    Links are few, so their frames are numbered by days."""
    e = F.col("event_id")
    every = lambda n, x: F.when(e % n == 0, x).otherwise(0).cast("long")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % LINKS).alias("link"), "ts", "event_id")
    rows = numbered(rows, out="k", order=("ts", "event_id"), by=F.col("ts").cast("date")).drop("ts")
    link, k = F.col("link"), F.col("k")
    comma = F.when(e % 97 == 0, 0).otherwise(COMMA)
    w0 = compose(a=(comma, 0), b=(every(89, 1) + 1, 8), c=(link * 9 + every(113, 1), 13), d=(every(101, 5), 24), e=(every(103, 3), 48))

    def cold(shift: int):
        convert = (k + 256 + every(83 + shift, 1)) % 32768
        word0 = compose(a=(every(107 + shift, 2), 0), b=(every(109 + shift, 1), 4), c=(every(127, 7), 8), d=(F.pmod(e * 7919, F.lit(65536)), 16), e=(convert, 48))
        word1 = compose(a=(every(131 + shift, 9), 0), b=(every(137, 1), 16), c=(every(139, 1) + 4 + link, 32))
        return word0, word1

    (a0, b0), (a1, b1) = cold(0), cold(6)
    return rows.select(
        "link", "k", "event_id", w0.alias("w0"), (1_000_000 + TICKS_PER_SAMPLE * k + every(79, TICKS_PER_SAMPLE)).alias("tick"),
        a0.alias("a0"), b0.alias("b0"), a1.alias("a1"), b1.alias("b1"),
        (1 - every(149, 1) + every(157, 32)).alias("sof_bits"), ((1 << (FRAME_WORDS - 1)) - every(163, 1 << (FRAME_WORDS - 1)) + every(167, 8)).alias("eof_bits"),
        (e % 151 == 0).alias("eof_error"), (e % 17 != 0).alias("run_enable"), (e % 173 == 0).alias("flush"),
    )


def _cold_sql(n: int, shift: int) -> str:
    every = lambda n, x: f"(CASE WHEN event_id % {n} = 0 THEN {x} ELSE 0 END)"
    convert = f"((k + 256 + {every(83 + shift, 1)}) % 32768)"
    return f"""CAST({every(107 + shift, 2)} | ({every(109 + shift, 1)} << 4) | ({every(127, 7)} << 8) | (((event_id * 7919) % 65536) << 16) | (CAST({convert} AS BIGINT) << 48) AS BIGINT) AS a{n},
        CAST({every(131 + shift, 9)} | ({every(137, 1)} << 16) | (CAST({every(139, 1)} + 4 + link AS BIGINT) << 32) AS BIGINT) AS b{n}"""


FRAMES = f"""frames AS (
    SELECT link, k, event_id,
        CAST((CASE WHEN event_id % 97 = 0 THEN 0 ELSE {COMMA} END) | ((CASE WHEN event_id % 89 = 0 THEN 2 ELSE 1 END) << 8)
            | (CAST(link * 9 + CASE WHEN event_id % 113 = 0 THEN 1 ELSE 0 END AS BIGINT) << 13)
            | (CAST(CASE WHEN event_id % 101 = 0 THEN 5 ELSE 0 END AS BIGINT) << 24)
            | (CAST(CASE WHEN event_id % 103 = 0 THEN 3 ELSE 0 END AS BIGINT) << 48) AS BIGINT) AS w0,
        1000000 + {TICKS_PER_SAMPLE} * k + CASE WHEN event_id % 79 = 0 THEN {TICKS_PER_SAMPLE} ELSE 0 END AS tick,
        {_cold_sql(0, 0)}, {_cold_sql(1, 6)},
        CAST(CASE WHEN event_id % 149 = 0 THEN 0 ELSE 1 END + CASE WHEN event_id % 157 = 0 THEN 32 ELSE 0 END AS BIGINT) AS sof_bits,
        CAST(CASE WHEN event_id % 163 = 0 THEN 0 ELSE {1 << (FRAME_WORDS - 1)} END + CASE WHEN event_id % 167 = 0 THEN 8 ELSE 0 END AS BIGINT) AS eof_bits, event_id % 151 = 0 AS eof_error, event_id % 17 <> 0 AS run_enable, event_id % 173 = 0 AS flush
    FROM (SELECT user_id % {LINKS} AS link, event_id,
        row_number() OVER (PARTITION BY user_id % {LINKS} ORDER BY ts, event_id) - 1 AS k FROM events)
)"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ch, ts, event_id, cmd): events as timing messages. 1 starts a run, 2 stops it, 8 triggers, 0 is data."""
    cmd = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "error", 8).otherwise(0)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("ch"), "ts", "event_id", cmd.cast("int").alias("cmd"))


COMMANDS = """commands AS (
    SELECT user_id AS ch, ts, event_id,
        CAST(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 8 ELSE 0 END AS INTEGER) AS cmd FROM events
)"""


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trg_id, ch, t0): errors as triggers."""
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("trg_id"), F.col("user_id").alias("ch"), F.col("ts").alias("t0"))


TRIGGERS = "triggers AS (SELECT event_id AS trg_id, user_id AS ch, ts AS t0 FROM events WHERE event_type = 'error')"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, pkt, beg, fin, n): a channel's packets with the microseconds they cover: half-open, to the next packet's begin or a second
    behind the last sample."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = samples(spark, sf_dir).groupBy("ch", "pkt").agg(F.min(micros).alias("beg"), F.max(micros).alias("last"), F.count(F.lit(1)).alias("n"))
    after = F.lead("beg").over(Window.partitionBy("ch").orderBy("pkt"))
    return rows.select(F.col("ch").alias("src"), "pkt", "beg", F.coalesce(after, F.col("last") + 1_000_000).alias("fin"), "n")


PACKETS = (
    SAMPLES
    + """, packets AS (
    SELECT ch AS src, pkt, beg, coalesce(lead(beg) OVER (PARTITION BY ch ORDER BY pkt), last + 1000000) AS fin, n
    FROM (SELECT ch, pkt, min(epoch_us(ts)) AS beg, max(epoch_us(ts)) AS last, count(*) AS n FROM samples GROUP BY ch, pkt)
)"""
)


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, host, name, idx, kind, value): regions, nations and suppliers as a tree of status variables."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    rows = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    base = F.concat(F.col("r_name"), F.lit(":"), F.col("n_name"), F.lit("("), (F.col("s_suppkey") % 4).cast("string"), F.lit("):"))
    leaf = F.explode(
        F.array(
            F.struct(F.lit("Name").alias("name"), F.lit("config").alias("kind"), F.col("s_name").alias("value")),
            F.struct(F.lit("Balance").alias("name"), F.lit("status").alias("kind"), F.floor("s_acctbal").cast("string").alias("value")),
            F.struct(F.lit("Key").alias("name"), F.lit("status").alias("kind"), F.col("s_suppkey").cast("string").alias("value")),
        )
    )
    return rows.select(base.alias("base"), F.col("n_name").alias("host"), (F.col("s_suppkey") % 4).cast("int").alias("idx"), "s_suppkey", leaf.alias("x")).select(
        F.concat("base", "x.name").alias("path"), "host", F.col("x.name").alias("name"), "idx", F.col("x.kind").alias("kind"), F.col("x.value").alias("value"), "s_suppkey"
    )


TREE = """tree AS (
    SELECT r_name || ':' || n_name || '(' || CAST(s_suppkey % 4 AS VARCHAR) || '):' || x.name AS path, n_name AS host, x.name AS name,
        CAST(s_suppkey % 4 AS INTEGER) AS idx, x.kind AS kind, x.value AS value, s_suppkey
    FROM (SELECT *, unnest([
            {'name': 'Name', 'kind': 'config', 'value': s_name},
            {'name': 'Balance', 'kind': 'status', 'value': CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR)},
            {'name': 'Key', 'kind': 'status', 'value': CAST(s_suppkey AS VARCHAR)}]) AS x
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
)"""
