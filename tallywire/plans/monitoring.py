"""Queries over counters, rates, requests and control tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywire.functions import scalars as S
from tallywire.functions.bits import line_checksum
from tallywire.operators import monitor as M
from tallywire.plans.register import query
from tallywire.sources.text import hex_records
from tallywire.sources.views import table


def log(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.length("props").cast("long").alias("bytes"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS beg, count(*) AS records, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY 1")
def rate_per_hour(spark, sf_dir):
    return M.rates(log(spark, sf_dir), "1 hour")


@query("SELECT user_id, time_bucket(INTERVAL 1 SECOND, ts, TIMESTAMP '1970-01-01') AS beg, count(*) AS records, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY 1, 2")
def link_rates(spark, sf_dir):
    """Frames and bytes of each link by the second."""
    return M.rates(log(spark, sf_dir), "1 second", keys=("user_id",))


@query("""WITH s AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR]) AS beg, length(props) AS b FROM events)
    SELECT beg, count(*) AS records, CAST(sum(b) AS BIGINT) AS bytes FROM s GROUP BY beg""")
def sliding_rate(spark, sf_dir):
    return M.sliding_rates(log(spark, sf_dir), "2 hours", "1 hour")


@query("""WITH c AS (SELECT o_custkey % 32 AS link, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 5000 AS v FROM orders)
    SELECT link, o_orderkey, v, greatest(v - lag(v) OVER (PARTITION BY link ORDER BY o_orderkey), 0) AS step FROM c""")
def clamped_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 32).alias("link"), "o_orderkey", (F.floor("o_totalprice").cast("long") % 5000).alias("v"))
    return M.clamped_steps(rows, key="link", order="o_orderkey", value="v")


@query("""SELECT user_id, CAST(sum(length(props)) * 8 AS BIGINT) AS bits, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros,
    round(sum(length(props)) * 8.0 / ((epoch_us(max(ts)) - epoch_us(min(ts))) * 1000.0), 9) AS gbps FROM events GROUP BY user_id HAVING max(ts) > min(ts)""")
def bandwidth(spark, sf_dir):
    micros = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    out = log(spark, sf_dir).groupBy("user_id").agg((F.sum("bytes") * 8).alias("bits"), micros.alias("micros")).filter("micros > 0")
    return out.withColumn("gbps", F.round(F.col("bits").cast("double") / (F.col("micros") * 1000.0), 9))


@query("""WITH d AS (SELECT user_id % 16 AS dpm, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1, 2),
    c AS (SELECT dpm, day, CAST(sum(e) OVER (PARTITION BY dpm, date_trunc('month', day) ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS errors FROM d),
    l AS (SELECT *, coalesce(lag(errors) OVER (PARTITION BY dpm ORDER BY day), 0) AS before FROM c)
    SELECT dpm, day, errors, CASE WHEN errors > before THEN 'Error' WHEN errors > 0 THEN 'Warning' ELSE 'Ready' END AS state FROM l""")
def health_state(spark, sf_dir):
    """Errors so far in the month, and what they say by the day."""
    days = log(spark, sf_dir).groupBy((F.col("user_id") % 16).alias("dpm"), F.col("ts").cast("date").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("e"))
    w = Window.partitionBy("dpm", F.trunc("day", "month")).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return M.health(days.withColumn("errors", F.sum("e").over(w)).drop("e"), key="dpm", order="day", errors="errors")


@query("SELECT CAST(o_orderdate AS DATE) AS day, bool_or(o_orderpriority = '1-URGENT' AND o_custkey % 10 <> 3) OR bool_or(o_custkey % 97 = 0) AS busy FROM orders GROUP BY 1")
def busy_or(spark, sf_dir):
    """Busy by the day: any source that is not masked, or forced."""
    raised = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_custkey") % 10 != 3)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg((F.bool_or(raised) | F.bool_or(F.col("o_custkey") % 97 == 0)).alias("busy"))


@query("SELECT length(props) AS size, count(*) AS n FROM events GROUP BY length(props)")
def read_size_profile(spark, sf_dir):
    return log(spark, sf_dir).groupBy(F.col("bytes").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_suppkey, count(*) FILTER (m & 1 = 1) AS sequence, count(*) FILTER (m & 2 = 2) AS size, count(*) FILTER (m & 4 = 4) AS value
    FROM (SELECT l_suppkey, (l_partkey + l_linenumber) % 8 AS m FROM lineitem) GROUP BY l_suppkey""")
def error_class_totals(spark, sf_dir):
    bit = lambda k: F.shiftright("m", k).bitwiseAND(F.lit(1).cast("long")) == 1
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", ((F.col("l_partkey") + F.col("l_linenumber")) % 8).alias("m"))
    return rows.groupBy("l_suppkey").agg(*[F.count_if(bit(k)).alias(n) for k, n in enumerate(("sequence", "size", "value"))])


@query("SELECT event_type, count(*) AS messages, count(DISTINCT user_id) AS devices FROM events GROUP BY event_type")
def leaf_counts(spark, sf_dir):
    return log(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("user_id").alias("devices"))


@query("""WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS b FROM events GROUP BY 1, 2)
    SELECT user_id, day, n - lag(n) OVER w AS dn, b - lag(b) OVER w AS db FROM c WINDOW w AS (PARTITION BY user_id ORDER BY day)""")
def counter_differences(spark, sf_dir):
    days = log(spark, sf_dir).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    w = Window.partitionBy("user_id").orderBy("day")
    return days.select("user_id", "day", (F.col("n") - F.lag("n").over(w)).alias("dn"), (F.col("b") - F.lag("b").over(w)).alias("db"))


REQUESTS = """requests AS (SELECT event_id % 4096 AS context, user_id AS address, epoch_us(ts) AS t FROM events WHERE event_id % 3 <> 0),
    responses AS (SELECT (event_id + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) % 4096 AS context, user_id AS address, epoch_us(ts) + (event_id % 400) * 1000 AS rt FROM events WHERE event_id % 7 <> 0)"""


def _requests(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("address"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    e = F.col("event_id")
    requests = rows.filter(e % 3 != 0).select((e % 4096).alias("context"), "address", "t")
    responses = rows.filter(e % 7 != 0).select(((e + F.when(e % 10 == 0, 1).otherwise(0)) % 4096).alias("context"), "address", (F.col("t") + (e % 400) * 1000).alias("rt"))
    return requests, responses


@query(f"WITH {REQUESTS} SELECT context, address, t, rt FROM requests JOIN responses USING (context, address)")
def request_match(spark, sf_dir):
    return M.matched(*_requests(spark, sf_dir)).select("context", "address", "t", "rt")


@query(f"WITH {REQUESTS} SELECT context, address, rt FROM responses r WHERE NOT EXISTS (SELECT 1 FROM requests q WHERE q.context = r.context AND q.address = r.address)")
def request_unexpected(spark, sf_dir):
    return M.unexpected(*_requests(spark, sf_dir)).select("context", "address", "rt")


@query(f"WITH {REQUESTS} SELECT q.context, q.address, q.t FROM requests q LEFT JOIN responses r USING (context, address) GROUP BY q.context, q.address, q.t HAVING NOT coalesce(bool_or(rt - t <= 250000), false)")
def request_timeout(spark, sf_dir):
    return M.timed_out(*_requests(spark, sf_dir), 250_000)


@query("SELECT event_id, user_id FROM events WHERE user_id % 8 IN (1, 2, 5)")
def source_routing(spark, sf_dir):
    """Messages to a destination that is in the list of data sources."""
    listed = F.broadcast(spark.createDataFrame([(1,), (2,), (5,)], "dest long"))  # at most 256 destinations
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("user_id") % 8).alias("dest"))
    return rows.join(listed, "dest", "left_semi").select("event_id", "user_id")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY")
def mysql_poll(spark, sf_dir):
    """Rows of a table that changed lately, in order of the change."""
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderdate").alias("last")).select(F.col("last") - F.expr("INTERVAL 30 DAY")).scalar()
    return orders.filter(F.col("o_orderdate") > last).orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1000 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return M.newest(rows, rows.filter("c_custkey % 7 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1000), "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def expire_rows(spark, sf_dir):
    """What is left when old rows are deleted."""
    return table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query("SELECT user_id, max(event_id) AS newest, count(*) - 1 AS ser FROM events GROUP BY user_id")
def serial_numbers(spark, sf_dir):
    """Repeated replacement: the newest row of each key, and how often it was replaced."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("newest"), (F.count(F.lit(1)) - 1).alias("ser"))


@query("""WITH l AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_id % 2 = 0 GROUP BY user_id)
    SELECT e.user_id, e.event_id FROM events e LEFT JOIN l USING (user_id) WHERE l.last IS NULL OR e.event_id > l.last""")
def newer_serials(spark, sf_dir):
    """Rows newer than the last one seen of their key."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id")
    seen = rows.filter("event_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("last"))
    return rows.join(seen, "user_id", "left").filter("last is null or event_id > last").select("user_id", "event_id")


@query("SELECT 0 AS dest, s_suppkey AS id, 'supplier' AS stream FROM supplier UNION ALL SELECT 1, c_custkey, 'customer' FROM customer UNION ALL SELECT 255, event_id, 'timing' FROM events WHERE event_type = 'error'")
def mux_union(spark, sf_dir):
    stream = lambda t, c, dest, name: table(spark, sf_dir, t).select(F.lit(dest).alias("dest"), F.col(c).alias("id"), F.lit(name).alias("stream"))
    timing = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.lit(255).alias("dest"), F.col("event_id").alias("id"), F.lit("timing").alias("stream"))
    return stream("supplier", "s_suppkey", 0, "supplier").unionByName(stream("customer", "c_custkey", 1, "customer")).unionByName(timing)


@query("SELECT event_id, 'data' AS record FROM events UNION ALL SELECT min(event_id), 'start' FROM events UNION ALL SELECT max(event_id), 'stop' FROM events")
def run_markers(spark, sf_dir):
    """Data with the records that start and stop its run."""
    events = table(spark, sf_dir, "events")
    ends = events.agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).select(F.explode(F.array(F.struct(F.col("a").alias("event_id"), F.lit("start").alias("record")), F.struct(F.col("b").alias("event_id"), F.lit("stop").alias("record")))).alias("x"))
    return events.select("event_id", F.lit("data").alias("record")).unionByName(ends.select("x.*"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def bad_buffers_antijoin(spark, sf_dir):
    bad = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(bad, "p_partkey", "left_anti")


@query("""WITH b AS (SELECT p_partkey, p_partkey % 5 <> 0 AND p_partkey % 7 <> 1 AS ok FROM part), g AS (SELECT p_partkey, p_partkey - row_number() OVER (ORDER BY p_partkey) AS grp FROM b WHERE NOT ok)
    SELECT min(p_partkey) AS beg, max(p_partkey) AS fin FROM g GROUP BY grp""")
def bad_buffer_ranges(spark, sf_dir):
    """Runs of neighbouring bad buffers. A run begins where the number before is not bad too."""
    bad = table(spark, sf_dir, "part").filter("p_partkey % 5 = 0 or p_partkey % 7 = 1").select("p_partkey")
    # neighbours by equal joins, so that no task sees all buffers; runs are then closed inside blocks of numbers and
    # joined over block ends by their edges
    begins = bad.join(bad.select((F.col("p_partkey") + 1).alias("p_partkey")), "p_partkey", "left_anti").select(F.col("p_partkey").alias("at"), F.lit(0).alias("edge"))
    ends = bad.join(bad.select((F.col("p_partkey") - 1).alias("p_partkey")), "p_partkey", "left_anti").select(F.col("p_partkey").alias("at"), F.lit(1).alias("edge"))
    edges = begins.unionByName(ends).withColumn("block", S.floor_div(F.col("at"), 65536))
    carried = edges.groupBy("block").agg(F.min(F.struct("at", "edge")).alias("first"))
    following = Window.orderBy("block")
    after = carried.select("block", F.lead("first").over(following).alias("next"))  # a row for 65536 numbers
    w = Window.partitionBy("block").orderBy("at", "edge")
    closed = edges.withColumn("fin", F.lead("at").over(w)).join(after, "block", "left").filter("edge = 0")
    return closed.select(F.col("at").alias("beg"), F.coalesce("fin", "next.at").alias("fin"))


@query("""WITH x AS (SELECT user_id, ts, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
    s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM x)
    SELECT user_id, min(ts) AS beg, max(ts) AS fin, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions_by_gap(spark, sf_dir):
    return M.sessions(log(spark, sf_dir), "30 minutes", key="user_id")


@query("""WITH p AS (SELECT p_partkey, upper(printf('%04x', CAST(p_partkey % 65536 AS INTEGER))) AS addr, upper(printf('%02x%02x%02x%02x', p_size, CAST(p_partkey % 256 AS INTEGER), 17, 255)) AS data FROM part),
    b AS (SELECT *, 4 + (CAST('0x' || substr(addr, 1, 2) AS BIGINT)) + (CAST('0x' || substr(addr, 3, 2) AS BIGINT)) + (CAST('0x' || substr(data, 1, 2) AS BIGINT)) + (CAST('0x' || substr(data, 3, 2) AS BIGINT)) + 17 + 255 AS s FROM p)
    SELECT p_partkey, CAST((256 - s % 256) % 256 AS BIGINT) AS checksum FROM b""")
def hex_checksum(spark, sf_dir):
    """Checksums of the lines of a memory image, such that all bytes of a line sum to 0 modulo 256."""
    digits = F.concat(F.lit("04"), F.lpad(F.hex(F.col("p_partkey") % 65536), 4, "0"), F.lit("00"), F.lpad(F.hex(F.col("p_size").cast("long")), 2, "0"), F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0"), F.lit("11FF"))
    return table(spark, sf_dir, "part").select("p_partkey", ((256 - line_checksum(digits)) % 256).alias("checksum"))


@query("""WITH t AS (SELECT p_partkey AS line_no, p_partkey // 50 AS image, CASE WHEN p_partkey % 10 = 0 THEN p_partkey % 256 END AS base, p_partkey % 65536 AS a FROM part)
    SELECT image, line_no, coalesce(last_value(base IGNORE NULLS) OVER (PARTITION BY image ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) * 65536 + a AS address FROM t""")
def hex_addresses(spark, sf_dir):
    """Full addresses of data lines: the last extended address of their image counts."""
    image = S.floor_div(F.col("p_partkey"), 50)
    hexed = lambda x, n: F.lpad(F.hex(x), n, "0")
    base = F.concat(F.lit(":02000004"), hexed(F.col("p_partkey") % 256, 4), F.lit("00"))
    data = F.concat(F.lit(":01"), hexed(F.col("p_partkey") % 65536, 4), F.lit("00AA00"))
    two = F.when(F.col("p_partkey") % 10 == 0, F.array(base, data)).otherwise(F.array(data))
    lines = table(spark, sf_dir, "part").select(image.alias("image"), F.col("p_partkey").alias("n"), F.posexplode(two).alias("k", "text")).select("image", "n", (2 * F.col("n") + F.col("k")).alias("line_no"), "text")
    return hex_records(lines, key="image").filter("type = 0").select("image", S.floor_div(F.col("line_no"), 2).alias("line_no"), "address")


@query("SELECT c_custkey, round((CAST(c_acctbal AS DOUBLE) + 273.5) * 0.25 - 10, 6) AS temperature, printf('%.1f', (floor(c_acctbal) + 273.5) * 0.25 - 10) || ' C' AS shown FROM (SELECT c_custkey, c_acctbal FROM customer) WHERE (floor(c_acctbal) * 10) % 2 = 0")
def unit_conversion(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    whole = S.linear(F.floor("c_acctbal"), 273.5, 0.25, -10.0)
    return rows.select("c_custkey", F.round(S.linear(F.col("c_acctbal"), 273.5, 0.25, -10.0), 6).alias("temperature"), S.with_unit(whole, "C").alias("shown"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' END AS label, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
def enum_label(spark, sf_dir):
    """Codes to labels and back; null for what is not listed."""
    labels = {1: "Finished", 2: "Open"}
    code = S.code_of(F.col("o_orderstatus"), {1: "F", 2: "O"})
    return table(spark, sf_dir, "orders").select("o_orderkey", code.alias("c")).select("o_orderkey", S.label_of(F.col("c"), labels).alias("label"), F.col("c").alias("code"))


@query("SELECT event_id, CASE user_id % 4 WHEN 0 THEN 10000 WHEN 1 THEN 8333 WHEN 2 THEN 500 ELSE 1000000 END AS period FROM events")
def run_period(spark, sf_dir):
    label = F.element_at(F.array(*[F.lit(x) for x in ("100Hz", "120Hz", "2000Hz", "fast")]), (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", S.run_period(label).alias("period"))


@query("SELECT s_suppkey, CAST(((s_nationkey % 6) + 1 - 1) * 8 + (s_suppkey % 4) * 2 + CASE WHEN s_suppkey % 3 = 2 THEN 1 ELSE 0 END AS BIGINT) AS rce FROM supplier")
def rce_index(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.rce_index((F.col("s_nationkey") % 6 + 1).cast("long"), F.col("s_suppkey") % 4, F.col("s_suppkey") % 3).alias("rce"))


@query("SELECT p_partkey, CAST(CASE WHEN v >= 2048 THEN v - 4096 ELSE v END AS BIGINT) AS signed FROM (SELECT p_partkey, (p_partkey * 37) % 4096 AS v FROM part)")
def sign_extend(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.sign_extend((F.col("p_partkey") * 37) % 4096, 12).alias("signed"))


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey WHEN c_custkey % 3 = 1 THEN c_custkey + 1 ELSE 0 END AS BIGINT) AS number FROM customer")
def number_parse(spark, sf_dir):
    """Decimal and hexadecimal texts as numbers, 0 for names."""
    text = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("0x"), F.lower(F.hex(F.col("c_custkey") + 1)))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(S.parse_int(text), F.lit(0).cast("long")).alias("number"))


@query("SELECT event_id, (a - b) * 1000000000 + (na - nb) AS ns FROM (SELECT event_id, event_id AS a, user_id AS b, (event_id * 7919) % 1000000000 AS na, (user_id * 104729) % 1000000000 AS nb FROM events)")
def time_difference(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select("event_id", S.elapsed_ns(e, (e * 7919) % 1000000000, u, (u * 104729) % 1000000000).alias("ns"))


@query("SELECT p_partkey, regexp_replace(p_name || ' ' || chr(10) || p_type, '[ \n\r\t]', '', 'g') AS stripped, hex(p_partkey) AS hexed, bin(p_partkey) AS binary_digits FROM part")
def number_texts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.strip(F.concat("p_name", F.lit(" \n"), "p_type")).alias("stripped"), F.hex("p_partkey").alias("hexed"), F.bin("p_partkey").alias("binary_digits"))


@query("""SELECT p_partkey, octet_length(CAST(p_name AS BLOB)) // 4 + 1 AS n_words, CAST(ord(substr(p_name, 1, 1)) + 256 * ord(substr(p_name, 2, 1)) + 65536 * ord(substr(p_name, 3, 1)) + 16777216 * CAST(ord(substr(p_name, 4, 1)) AS BIGINT) AS BIGINT) AS first_word, p_name AS again FROM part""")
def cstring_words(spark, sf_dir):
    """Names as 32-bit words with a closing zero, and the names again."""
    rows = table(spark, sf_dir, "part").select("p_partkey", S.string_words(F.col("p_name")).alias("words"))
    return rows.select("p_partkey", F.size("words").cast("long").alias("n_words"), F.get("words", F.lit(0)).alias("first_word"), S.words_string(F.col("words")).alias("again"))


@query("SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 25")
def run_triggers(spark, sf_dir):
    """A run of 25 triggers, which then stops."""
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "ts").orderBy("ts", "event_id").limit(25)


@query("SELECT s_suppkey, 'Celsius' AS name, round(s_acctbal * 0.25 - 40, 6) AS value FROM supplier UNION ALL SELECT s_suppkey, 'Negative' AS name, CASE WHEN s_acctbal < 0 THEN 1.0 ELSE 0.0 END AS value FROM supplier")
def linked_conversions(spark, sf_dir):
    """Variables that are no registers: each is linked to another one through a function of the user's."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("Balance").alias("name"), F.col("s_acctbal").alias("value"))
    links = [("Celsius", "Balance", lambda v: F.round(v * 0.25 - 40, 6)), ("Negative", "Balance", lambda v: (v < 0).cast("double"))]
    return M.linked(rows, links)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'on' ELSE s_name END AS value FROM supplier WHERE s_suppkey % 2 = 0")
def set_by_name(spark, sf_dir):
    """Variables set by name, then read by name: the last setting of each counts, unknown names are left out."""
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("name:"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_name").alias("value"), "s_suppkey")
    keys = rows.filter("s_suppkey % 3 = 0").select("path")
    settings = keys.select("path", F.lit(1).alias("n"), F.lit("off").alias("value")).unionByName(keys.select("path", F.lit(2).alias("n"), F.lit("on").alias("value")))
    return M.set_values(rows, settings.unionByName(spark.createDataFrame([("name:none", 1, "x")], "path string, n int, value string"))).filter("s_suppkey % 2 = 0").select("s_suppkey", "value")
