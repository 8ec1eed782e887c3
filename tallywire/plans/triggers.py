"""Queries that select data around triggers, and build records of it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywire.functions import scalars as S
from tallywire.functions.bits import TOC_ENTRY, bit_length, compose, fields, lit
from tallywire.operators import queues as Q
from tallywire.operators import triggers as O
from tallywire.plans.register import query
from tallywire.sources.views import COMMANDS, PACKETS, TRIGGERS, commands, packets, samples, table, triggers

HOUR = 3_600_000_000
BEFORE, LENGTH = HOUR, 2 * HOUR
SELECTED = f"""{PACKETS}, {TRIGGERS}, selected AS (
    SELECT t.trg_id, t.ch, p.src, p.pkt, p.beg, p.fin, p.n, epoch_us(t.t0) - {BEFORE} AS win_beg, epoch_us(t.t0) - {BEFORE} + {LENGTH} AS win_fin
    FROM triggers t JOIN packets p ON p.src = t.ch AND p.beg < epoch_us(t.t0) - {BEFORE} + {LENGTH} AND p.fin > epoch_us(t.t0) - {BEFORE})"""


def selected(spark, sf_dir):
    trg = triggers(spark, sf_dir).withColumn("t0", F.unix_micros(F.col("t0").cast("timestamp")))
    # packets may last for weeks: buckets of a week keep what each of them enters small
    return O.in_window(trg, packets(spark, sf_dir), BEFORE, LENGTH, keys={"ch": "src"}, span=7 * 24 * HOUR)


@query(f"WITH {SELECTED} SELECT trg_id, src, pkt, beg, fin FROM selected")
def trigger_window(spark, sf_dir):
    return selected(spark, sf_dir).select("trg_id", "src", "pkt", "beg", "fin")


@query(f'WITH {SELECTED} SELECT trg_id, src, pkt, greatest(beg, win_beg) AS "from", least(fin, win_fin) AS upto FROM selected')
def trigger_trim(spark, sf_dir):
    return O.trimmed(selected(spark, sf_dir)).select("trg_id", "src", "pkt", "from", "upto")


@query(f"WITH {SELECTED} SELECT trg_id, src, CAST(sum(least(fin, win_fin) - greatest(beg, win_beg)) AS BIGINT) AS covered, sum(least(fin, win_fin) - greatest(beg, win_beg)) < {LENGTH} AS missing FROM selected GROUP BY trg_id, src")
def trigger_coverage(spark, sf_dir):
    """Of each window, what its packets cover, and whether anything is missing."""
    out = O.trimmed(selected(spark, sf_dir)).groupBy("trg_id", "src").agg(F.sum(F.col("upto") - F.col("from")).alias("covered"))
    return out.withColumn("missing", F.col("covered") < LENGTH)


@query(f"""WITH {SELECTED} SELECT trg_id, CAST(sum(n) AS BIGINT) AS bytes, count(DISTINCT src) AS streams, count(*) AS packets, min(greatest(beg, win_beg)) AS beg,
    max(least(fin, win_fin)) AS fin FROM selected GROUP BY trg_id""")
def fragment_summary(spark, sf_dir):
    """Nested records of all triggers, read back."""
    made = O.fragments(O.trimmed(selected(spark, sf_dir)))
    flat = made.select("trg_id", "bytes", F.size("streams").cast("long").alias("streams"), F.flatten(F.col("streams.packets")).alias("p"))
    return flat.select("trg_id", "bytes", "streams", F.size("p").cast("long").alias("packets"), F.array_min("p.from").alias("beg"), F.array_max("p.upto").alias("fin"))


@query("SELECT trg_id, ch, seq FROM (SELECT event_id AS trg_id, user_id AS ch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events WHERE event_type = 'error') WHERE seq % 8 < 3")
def trigger_prescale(spark, sf_dir):
    return O.prescaled(triggers(spark, sf_dir), 3, 8, key="ch").select("trg_id", "ch", "seq")


RUNNING = f"""{COMMANDS}, gated AS (SELECT *, coalesce(last_value(CASE WHEN cmd IN (1, 2) THEN cmd END IGNORE NULLS)
    OVER (PARTITION BY ch ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1, false) AS running FROM commands)"""


@query(f"WITH {RUNNING} SELECT ch, event_id, cmd, running FROM gated")
def run_gating(spark, sf_dir):
    return O.run_state(commands(spark, sf_dir)).select("ch", "event_id", "cmd", "running")


@query(f"WITH {RUNNING} SELECT ch, count(*) FILTER (running AND cmd = 0) AS promoted, count(*) FILTER (NOT running AND cmd = 0) AS dropped FROM gated GROUP BY ch")
def gated_data(spark, sf_dir):
    running, data = F.col("running"), F.col("cmd") == 0
    return O.run_state(commands(spark, sf_dir)).groupBy("ch").agg(F.count_if(running & data).alias("promoted"), F.count_if(~running & data).alias("dropped"))


@query(f"WITH {COMMANDS} SELECT ch, event_id, row_number() OVER (PARTITION BY ch ORDER BY ts, event_id) - 1 AS event FROM commands")
def event_number(spark, sf_dir):
    return O.event_numbers(commands(spark, sf_dir)).select("ch", "event_id", "event")


@query(f"WITH {COMMANDS} SELECT event_id, (cmd >> 3) & 1 = 1 AS trigger, (cmd >> 3) & 1 = 1 AND event_id % 10 = 0 AS dropped FROM commands")
def trigger_decode(spark, sf_dir):
    """A message triggers if bit 3 of its command is set; it is dropped where the queue is busy."""
    hit = O.is_trigger(F.col("cmd"))
    return commands(spark, sf_dir).select("event_id", hit.alias("trigger"), (hit & (F.col("event_id") % 10 == 0)).alias("dropped"))


@query("SELECT ch, event_id, n FROM (SELECT user_id AS ch, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 7 = 0")
def every_nth(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("ch").orderBy("ts", "event_id")).cast("long")
    return commands(spark, sf_dir).withColumn("n", n).filter("n % 7 = 0").select("ch", "event_id", "n")


@query(f"""WITH {COMMANDS}, a AS (SELECT *, CAST(sum(CASE WHEN cmd = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY ch ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS arms FROM commands)
    SELECT ch, arms, arg_min(event_id, (ts, event_id)) AS event_id FROM a WHERE cmd = 8 AND arms > 0 GROUP BY ch, arms""")
def armed_trigger(spark, sf_dir):
    return O.armed(commands(spark, sf_dir)).select("ch", "arms", "event_id")


@query(f"""WITH {COMMANDS}, c AS (SELECT *, sum(CASE WHEN cmd = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY ch ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS clears FROM commands)
    SELECT ch, event_id, bool_or(cmd = 8) OVER (PARTITION BY ch, clears ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS latched FROM c""")
def latched_trigger(spark, sf_dir):
    return O.latched(commands(spark, sf_dir)).select("ch", "event_id", "latched")


@query(f"WITH {COMMANDS} SELECT event_id, epoch_us(ts) + 500 AS rise, epoch_us(ts) + 516 AS fall FROM commands WHERE cmd IN (1, 8)")
def opcode_mask(spark, sf_dir):
    rows = commands(spark, sf_dir).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    masks = F.broadcast(spark.createDataFrame([(1,), (8,)], "cmd int"))  # at most 256 codes
    return O.pulses(rows, masks, 500, 16).select("event_id", "rise", "fall")


LINES = "lines AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 13 AS bits FROM lineitem)"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity").cast("long") * 13).alias("bits"))


#: The order of an order's lines. Whatever is asked for in their order is windowed by it, so that lines are sorted once; lines that tie
#: are equal in all that is shown of them.
_ORDER = ("l_linenumber", "l_partkey", "bits")


def _numbered(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)).cast("long") - 1
    return lines(spark, sf_dir).withColumn("n", n)


NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, bits) - 1 AS n FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_quantity) AS BIGINT) * 13 AS bits FROM lineitem))"
OFFSETS = f"{NUMBERED}, offsets AS (SELECT *, CAST(coalesce(sum(bits) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM numbered)"


@query(f'WITH {OFFSETS} SELECT l_orderkey, n, bits, off AS "offset" FROM offsets')
def toc_offsets(spark, sf_dir):
    return O.toc(_numbered(spark, sf_dir), keys=("l_orderkey",), order=_ORDER, size="bits").select("l_orderkey", "n", "bits", "offset")


@query(f"WITH {OFFSETS} SELECT l_orderkey, n // 2 AS word, CAST(sum(off << CAST(32 * (n % 2) AS INTEGER)) AS BIGINT) AS packed FROM offsets GROUP BY l_orderkey, n // 2")
def toc_pack_pairs(spark, sf_dir):
    """Two offsets in each 64-bit word."""
    rows = O.toc(_numbered(spark, sf_dir), keys=("l_orderkey",), order=_ORDER, size="bits")
    after = F.shiftleft(F.lead("offset").over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)), 32)
    packed = F.col("offset").bitwiseOR(F.coalesce(after, F.lit(0).cast("long")))
    return rows.withColumn("packed", packed).filter("n % 2 = 0").select("l_orderkey", S.floor_div(F.col("n"), 2).alias("word"), "packed")


@query(f"WITH {OFFSETS} SELECT l_orderkey, n, (off + 63) // 64 AS offset64, CAST(2 | (1 << 4) | (((off + 63) // 64) << 8) AS BIGINT) AS entry FROM offsets")
def toc_entries(spark, sf_dir):
    """Table of contents entries: format, type and offset in words, composed and taken apart."""
    rows = O.toc(_numbered(spark, sf_dir), keys=("l_orderkey",), order=_ORDER, size="bits")
    words = S.floor_div(F.col("offset") + 63, 64)
    made = rows.select("l_orderkey", "n", compose(f=(F.lit(2), 0), t=(F.lit(1), 4), o=(words, 8)).alias("entry"))
    return made.select("l_orderkey", "n", fields(F.col("entry"), TOC_ENTRY)[2], "entry")


@query(f"WITH {NUMBERED} SELECT l_orderkey, CAST(((count(*) - 1) << 40) | (CAST(1023 AS BIGINT) << 28) | (CAST(sum(bits) AS BIGINT) << 8) | (2 << 4) | 1 AS BIGINT) AS descriptor FROM numbered GROUP BY l_orderkey")
def toc_descriptor(spark, sf_dir):
    out = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("channels"), F.sum("bits").alias("length"))
    word = compose(f=(F.lit(1), 0), t=(F.lit(2), 4), n=(F.col("length"), 8), s=(lit(1023), 28), c=(F.col("channels") - 1, 40))
    return out.select("l_orderkey", word.alias("descriptor"))


@query("SELECT user_id AS ch, event_id, CAST(coalesce(sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 200 AS file FROM events")
def file_rollover(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("ch"), "event_id", "ts", F.length("props").cast("long").alias("size"))
    return O.files(rows, 200, order=("ts", "event_id"), size="size", key="ch").select("ch", "event_id", "file")


@query(f'WITH {NUMBERED} SELECT l_orderkey, n, count(*) OVER (PARTITION BY l_orderkey) - n - 1 AS "left" FROM numbered')
def remaining_count(spark, sf_dir):
    left = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")) - F.col("n") - 1
    return _numbered(spark, sf_dir).select("l_orderkey", "n", left.alias("left"))


@query(f"WITH {NUMBERED} SELECT l_orderkey, n, max(bits) OVER (PARTITION BY l_orderkey ORDER BY n ROWS UNBOUNDED PRECEDING) AS most FROM numbered")
def running_max_bytes(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return _numbered(spark, sf_dir).select("l_orderkey", "n", F.max("bits").over(w).alias("most"))


@query(f"WITH {NUMBERED} SELECT l_orderkey, n, CAST((7 << 24) | (n << 16) | (l_partkey & 65535) AS BIGINT) AS idx, CAST((7 << 8) | n AS BIGINT) AS packet, CAST(l_partkey & 65535 AS BIGINT) AS sample FROM numbered")
def range_index(spark, sf_dir):
    """Where an event begins: packet number and sample in one index, and apart again."""
    idx = compose(s=(F.col("l_partkey").bitwiseAND(lit(65535)), 0), p=(lit(7 << 8).bitwiseOR(F.col("n")), 16))
    rows = _numbered(spark, sf_dir).select("l_orderkey", "n", idx.alias("idx"))
    return rows.select("l_orderkey", "n", "idx", F.shiftright("idx", 16).alias("packet"), F.col("idx").bitwiseAND(lit(65535)).alias("sample"))


@query("SELECT s_suppkey, s_name, CAST((s_suppkey & 15) | (5 << 4) AS BIGINT) AS head, CAST((s_nationkey << 8) | (s_suppkey % 4) AS BIGINT) AS location, upper(s_name) || chr(1) || n_name AS names FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def originator(spark, sf_dir):
    """Who made a record: its head, where it stands, two names behind each other, read back."""
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    head = compose(f=(F.col("s_suppkey").bitwiseAND(lit(15)), 0), t=(F.lit(5), 4))
    location = compose(element=(F.col("s_suppkey") % 4, 0), slot=(F.col("s_nationkey"), 8))
    made = rows.select("s_suppkey", "s_name", head.alias("head"), location.alias("location"), F.concat_ws("\0", F.upper("s_name"), "n_name").alias("raw"))
    return made.select("s_suppkey", "s_name", "head", "location", F.array_join(F.split("raw", "\0"), "\1").alias("names"))


@query(f"WITH {PACKETS} SELECT src, pkt, CAST(1 | (2 << 4) | ((src & 2047) << 8) | ((src * 3 & 2047) << 20) AS BIGINT) AS head, pkt AS sequence, beg AS stamp FROM packets")
def identifier(spark, sf_dir):
    head = compose(f=(F.lit(1), 0), t=(F.lit(2), 4), a=(F.col("src").bitwiseAND(lit(2047)), 8), b=((F.col("src") * 3).bitwiseAND(lit(2047)), 20))
    return packets(spark, sf_dir).select("src", "pkt", head.alias("head"), F.col("pkt").alias("sequence"), F.col("beg").alias("stamp"))


@query("""WITH s AS (SELECT user_id AS ch, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events), b AS (SELECT ch, min(seq) AS seq FROM s WHERE event_id % 5 = 0 GROUP BY ch)
    SELECT s.ch, count(*) FILTER (b.seq IS NULL OR s.seq < b.seq) AS head, count(*) FILTER (s.seq >= b.seq) AS tail FROM s LEFT JOIN b USING (ch) GROUP BY s.ch""")
def list_split(spark, sf_dir):
    """A list split at its first marked element; both parts, joined again, are the list."""
    rows = samples(spark, sf_dir).select("ch", "seq", "event_id")
    cut = rows.filter("event_id % 5 = 0").groupBy("ch").agg(F.min("seq").alias("cut"))
    before = F.col("cut").isNull() | (F.col("seq") < F.col("cut"))
    return rows.join(cut, "ch", "left").groupBy("ch").agg(F.count_if(before).alias("head"), F.count_if(~before).alias("tail"))


@query(f"WITH {NUMBERED} SELECT l_orderkey, n, CAST(CASE WHEN bits > 0 THEN length(ltrim(bin(bits), '0')) ELSE 0 END AS BIGINT) AS bit_length FROM numbered")
def bit_lengths(spark, sf_dir):
    return _numbered(spark, sf_dir).select("l_orderkey", "n", bit_length(F.col("bits")).cast("long").alias("bit_length"))


@query("""WITH RECURSIVE a AS (SELECT user_id % 8 AS link, event_id, event_id % 3 AS served, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS i FROM events),
    q AS (SELECT link, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS level, false AS dropped FROM (SELECT DISTINCT link FROM a)
        UNION ALL SELECT a.link, a.i, a.event_id, least(6, greatest(0, q.level - a.served) + 1), greatest(0, q.level - a.served) = 6 FROM q JOIN a ON a.link = q.link AND a.i = q.i + 1)
    SELECT link, event_id, level, dropped FROM q WHERE i > 0""")
def queue_admission(spark, sf_dir):
    """A queue of six places on each link: how full it is, and what it drops. By days, as links are few."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("link"), "event_id", "ts")
    day = F.unix_date(F.col("ts").cast("date"))
    return Q.admit(rows, room=6, served=F.col("event_id") % 3, order=("ts", "event_id"), by=day).select("link", "event_id", "level", "dropped")
