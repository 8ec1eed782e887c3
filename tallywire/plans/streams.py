"""Queries that run as streams: tables are written in slices of time and streamed, with a restart before every slice and a watermark
that lets state go."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywire.plans.files import record_bytes
from tallywire.plans.frames import STATUS
from tallywire.plans.register import query
from tallywire.sources import binary
from tallywire.sources.files import sizes, write_bytes
from tallywire.sources.folders import shared_root
from tallywire.sources.views import COMMANDS, SAMPLES, commands, frames, samples, table
from tallywire.streaming import state as S
from tallywire.streaming.counters import fan_out, listen, packets_by_tick, replay, run_available, source, triggered, windowed_rates


def _later(rows, at: str, by: str):
    """The time some way behind a table's last one, in one row."""
    return rows.agg((F.max(at) + F.expr(f"INTERVAL {by}")).alias(at)).filter(F.col(at).isNotNull())


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS beg, count(*) AS records, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY 1")
def stream_rates(spark, sf_dir):
    """Records and bytes by the hour; a window goes out when the watermark, two hours behind, has passed it. One late row closes the last ones."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.length("props").alias("bytes"))
    end = _later(rows, "ts", "4 hours").select("ts", F.lit(None).cast("int").alias("bytes"))
    out = replay([rows], lambda stream: windowed_rates(stream, late="2 hours"), order="ts", tail=[end])
    return out.withColumn("beg", F.col("beg").cast("timestamp_ntz"))


@query("""SELECT t.event_id AS trg_id, p.event_id AS event_id FROM events p JOIN events t ON p.user_id = t.user_id AND t.event_type = 'error' AND p.event_type <> 'error'
    AND p.ts >= t.ts - INTERVAL 6 HOUR AND p.ts < t.ts + INTERVAL 6 HOUR""")
def stream_trigger_window(spark, sf_dir):
    """What lies six hours around each trigger, by a join of two streams that forgets what no trigger can reach any more."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.col("ts").cast("timestamp").alias("at"), "event_id", "event_type")
    trg = rows.filter("event_type = 'error'").select(F.col("src").alias("trg_src"), F.col("at").alias("t0"), F.col("event_id").alias("trg_id"))
    both = lambda p, t: triggered(p.withColumnRenamed("t0", "at"), t, before="6 hours", after="6 hours", late="2 hours")
    found = replay([rows.filter("event_type <> 'error'").drop("event_type").withColumnRenamed("at", "t0"), trg], both, order="t0")
    return found.select("trg_id", "event_id")


@query(f"WITH {SAMPLES} SELECT ch, seq // 16 AS pkt, count(*) AS n, CAST(sum(adc) AS BIGINT) AS total FROM samples GROUP BY ch, seq // 16")
def stream_ticks(spark, sf_dir):
    """Packets by tick, whose number follows from the tick alone; each goes out behind the watermark."""
    # a sample's time is that of its tick: a second for each
    rows = samples(spark, sf_dir).select("ch", "seq", "adc", F.timestamp_seconds("seq").alias("at"))
    end = _later(rows, "at", "1 hour").select(F.lit(None).cast("long").alias("ch"), F.unix_seconds("at").alias("seq"), F.lit(0).cast("long").alias("adc"), "at")
    found = replay([rows], lambda stream: packets_by_tick(stream, late="1 minute"), order="at", tail=[end])
    return found.filter("ch IS NOT NULL")


@query(f"""WITH {SAMPLES} SELECT ch, min(seq) AS first, max(seq) AS last, count(*) AS n, CAST(sum(adc) AS BIGINT) AS total, count(*) < 16 AS flushed FROM samples GROUP BY ch, seq // 16""")
def stream_packets(spark, sf_dir):
    """Packets of exactly sixteen samples, counted in state; a last frame that flushes half of the channels, the others by their idle time."""
    rows = samples(spark, sf_dir).select("ch", "seq", F.col("adc").alias("value"), F.lit(False).alias("flush"), F.col("ts").cast("timestamp").alias("at"))
    none = F.lit(None).cast("long")
    flush = rows.filter("ch % 2 = 0").groupBy("ch").agg(F.max("at").alias("at")).select("ch", none.alias("seq"), none.alias("value"), F.lit(True).alias("flush"), "at")
    idle = _later(rows, "at", "800 days").select(none.alias("ch"), F.lit(0).cast("long").alias("seq"), none.alias("value"), F.lit(True).alias("flush"), "at")
    S.with_timers(spark)
    # a channel of these tables may rest for months between two of its samples
    return replay([rows], lambda stream: S.packets_by_count(stream, size=16, idle="400 days", late="1 day"), order="at", tail=[flush.unionByName(idle)])


@query(f"WITH {STATUS} SELECT link, k, status FROM checked")
def stream_status(spark, sf_dir):
    """The status of frames as a stream: what each link's frame before and first frame were is state, over a restart too."""
    rows = frames(spark, sf_dir).withColumn("at", F.timestamp_micros("tick"))
    S.with_timers(spark)
    return replay([rows], lambda stream: S.stream_status(stream.drop("at")), order="at").select("link", "k", "status")


@query(f"""WITH {COMMANDS}, s AS (SELECT ch, event_id, cmd, last_value(CASE WHEN cmd IN (1, 2) THEN cmd END IGNORE NULLS) OVER (PARTITION BY ch ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS said FROM commands)
    SELECT ch, event_id, cmd, coalesce(said = 1, false) AS running FROM s""")
def stream_gating(spark, sf_dir):
    """Events with the state of their channel's run, told by another stream of starts and stops."""
    rows = commands(spark, sf_dir).select("ch", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), "cmd")
    none = F.lit(None).cast("long")
    end = _later(rows, "at", "2 days").select(none.alias("ch"), none.alias("id"), "at", F.lit(0).alias("cmd"))
    S.with_timers(spark)
    data, control = rows.filter("cmd NOT IN (1, 2)"), rows.filter("cmd IN (1, 2)")
    found = replay([data, control], lambda d, c: S.gated(d, c, late="1 day"), order="at", tail=[end, end.limit(0)])
    return found.filter("ch IS NOT NULL").select("ch", F.col("id").alias("event_id"), "cmd", "running")


@query("""WITH r AS (SELECT c_custkey % 16 AS link, k // 97 AS epoch, k AS seq FROM (SELECT o_custkey AS c_custkey, o_orderkey AS k FROM orders))
    SELECT link, epoch, seq, coalesce(seq - 1 - lag(seq) OVER (PARTITION BY link, epoch ORDER BY seq), 0) AS missing FROM r""")
def stream_reconnects(spark, sf_dir):
    """Records missing before each, told by running numbers; a new connection begins anew, and so does nothing else."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 16).alias("link"), F.call_function("div", key, F.lit(97)).alias("epoch"), key.alias("seq"), F.timestamp_seconds(key).alias("at"))
    S.with_timers(spark)
    return replay([rows], lambda stream: S.sequence_gaps(stream), order="at")


@query("""WITH e AS (SELECT user_id AS path, ts, event_id AS n, event_type AS value, lag(event_type) OVER w AS before, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT path, n, value, CASE WHEN i = 1 THEN 'new' ELSE 'changed' END AS kind FROM e WHERE i = 1 OR value <> before""")
def stream_poll(spark, sf_dir):
    """A stream of polled values, of which only what is new or changed goes out."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("n"), F.col("event_type").alias("value"))
    S.with_timers(spark)
    return replay([rows], lambda stream: S.changes(stream), order="at").drop("at")


@query("SELECT CAST(user_id % 16 AS INTEGER) AS type, md5(props) AS body FROM events")
def stream_records(spark, sf_dir):
    """A stream written to a data file's records batch by batch, at most one file of the stream in a batch, and read back."""
    root = shared_root(spark, "channel")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("type"), F.encode("props", "UTF-8").alias("payload"))
    rows.repartition(3).write.parquet(f"{root}/in")

    def write(batch, number: int) -> None:
        spark.range(0).write.mode("ignore").parquet(f"{root}/out")  # the folder is there, whatever comes
        place = f"{root}/out/batch-{number}"
        if not _there(place):  # a batch that is run again is written already
            write_bytes(batch.select(record_bytes(F.col("type"), F.col("payload")).alias("data")), place)

    run_available(source(spark, f"{root}/in", rows.schema, files=1), f"{root}/run", batch=write)
    return binary.read_records(spark, f"{root}/out/batch-*").select("type", F.md5("payload").alias("body"))


def _there(place: str) -> bool:
    try:
        return bool(sizes(place))
    except FileNotFoundError:
        return False


def _kept(place: str, name: str, columns: list[str]):
    """A sink that keeps each batch's rows in a table; a batch that comes again takes the place of itself."""
    return lambda batch, number: batch.select(F.lit(name).alias("sink"), *columns).write.mode("overwrite").parquet(f"{place}/{name}/{number}")


@query("SELECT 'all' AS sink, event_id FROM events UNION ALL SELECT 'errors', event_id FROM events WHERE event_type = 'error' UNION ALL SELECT 'runs', event_id FROM events WHERE event_type IN ('signup', 'purchase')")
def stream_fan_out(spark, sf_dir):
    """A stream given to three sinks, each of which takes what it is for; a batch is computed once."""
    root = shared_root(spark, "sinks")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    rows.repartition(4).write.parquet(f"{root}/in")
    keep = lambda name, which: lambda batch, number: _kept(f"{root}/out", name, ["event_id"])(batch.filter(which), number)
    sinks = [keep("all", F.lit(True)), keep("errors", F.col("event_type") == "error"), keep("runs", F.col("event_type").isin("signup", "purchase"))]
    run_available(source(spark, f"{root}/in", rows.schema, files=2), f"{root}/run", batch=fan_out(sinks))
    return spark.read.schema("sink string, event_id long").parquet(f"{root}/out/*/*")


@query("""WITH e AS (SELECT user_id AS path, ts, event_id AS n, event_type AS value, lag(event_type) OVER w AS before, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT CASE WHEN i = 1 THEN 'new' ELSE 'changed' END AS sink, path, n FROM e WHERE i = 1 OR value <> before""")
def stream_listeners(spark, sf_dir):
    """Polled values whose changes go to listeners by their kind."""
    root = shared_root(spark, "listeners")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("n"), F.col("event_type").alias("value"))
    S.with_timers(spark)
    rows.write.parquet(f"{root}/in")
    listeners = {kind: _kept(f"{root}/out", kind, ["path", "n"]) for kind in ("new", "changed", "gone")}
    run_available(S.changes(source(spark, f"{root}/in", rows.schema)), f"{root}/run", batch=listen(listeners))
    return spark.read.schema("sink string, path long, n long").parquet(f"{root}/out/*/*")
