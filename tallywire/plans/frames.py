"""Queries over frames, their headers and packets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywire.functions import bits as B
from tallywire.functions import scalars as S
from tallywire.operators import framer as L
from tallywire.operators import frames as O
from tallywire.operators import ranges as R
from tallywire.plans.register import query
from tallywire.schema import COMMA, FIRST_FRAME_MASKS, STATUS_BITS, SYNC_PATTERN, TRAILER_PATTERN, UNKNOWN_SOURCE
from tallywire.sources.folders import written
from tallywire.sources.generators import frame_rows
from tallywire.sources.views import FRAMES, FRAMES_PER_PACKET, frames, table


def _sql_field(word: str, at: tuple[int, int]) -> str:
    return f"(({word} >> {at[0]}) & {(1 << at[1]) - 1})"


def _status_sql() -> str:
    head = lambda name: _sql_field("w0", B.FRAME_HEADER[name])
    over = "OVER (PARTITION BY link ORDER BY k)"
    checks = {
        "bad_comma": f"{head('comma')} <> {COMMA}", "bad_version": f"{head('version')} <> 1", "bad_id": f"{head('id')} <> first_value({head('id')}) {over}",
        "bad_errors": f"{head('errors')} <> 0", "bad_timestamp": f"tick <> lag(tick) {over} + 25", "run_disable": "NOT run_enable", "flush": "flush",
        "sof_missing": "sof_bits & 1 = 0", "sof_unexpected": "sof_bits >> 1 <> 0", "eof_missing": "eof_bits >> 29 = 0", "eof_unexpected": "eof_bits & 536870911 <> 0", "eof_error": "eof_error",
    }
    for n in (0, 1):
        convert, hdrs = _sql_field(f"a{n}", B.COLD_WORD0["convert"]), _sql_field(f"b{n}", B.COLD_WORD1["hdrs"])
        checks |= {f"cd{n}_{c}": f"{_sql_field(f'a{n}', B.COLD_WORD0[c])} <> 0" for c in ("stream_err1", "stream_err2", "rsvd0")}
        checks |= {f"cd{n}_{c}": f"{_sql_field(f'b{n}', B.COLD_WORD1[c])} <> 0" for c in ("err_reg", "rsvd1")}
        checks |= {f"cd{n}_convert": f"{convert} <> ((lag({convert}) {over} + 1) & 65535)", f"cd{n}_hdrs": f"{hdrs} <> lag({hdrs}) {over}"}
    return " + ".join(f"(CASE WHEN {check} THEN {1 << STATUS_BITS[name]} ELSE 0 END)" for name, check in checks.items())


STATUS = f"""{FRAMES}, raw_status AS (SELECT *, CAST({_status_sql()} AS BIGINT) AS every_bit FROM frames),
checked AS (SELECT * EXCLUDE (every_bit), CASE WHEN k = 0 THEN every_bit & {FIRST_FRAME_MASKS['as_written']} ELSE every_bit END AS status FROM raw_status)"""
KEPT = f"""{STATUS}, kept AS (SELECT *, n // {FRAMES_PER_PACKET} AS pkt, n % {FRAMES_PER_PACKET} AS frame FROM (
    SELECT *, row_number() OVER (PARTITION BY link ORDER BY k) - 1 AS n FROM checked WHERE (status >> 24) & 3 = 0))"""


def checked(spark, sf_dir, **counts):
    """Frames with their status. They are numbered once, in a table, so that numbering is not planned again for every use."""
    return O.status(written(frames(spark, sf_dir), "frames"), counts=counts)


def kept(spark, sf_dir):
    return O.packetise(checked(spark, sf_dir, written=O.promoted), FRAMES_PER_PACKET, number="written")


def _extract(word: str, layout: dict) -> str:
    return ", ".join(f"CAST({_sql_field(word, at)} AS BIGINT) AS {name}" for name, at in layout.items())


@query(f"WITH {FRAMES} SELECT link, k, {_extract('w0', B.FRAME_HEADER)} FROM frames")
def header_fields(spark, sf_dir):
    return frames(spark, sf_dir).select("link", "k", *B.fields(F.col("w0"), B.FRAME_HEADER))


@query(f"WITH {FRAMES} SELECT link, k, {_extract('a0', B.COLD_WORD0)}, {_extract('b0', B.COLD_WORD1)} FROM frames")
def cold_data_fields(spark, sf_dir):
    return frames(spark, sf_dir).select("link", "k", *B.fields(F.col("a0"), B.COLD_WORD0), *B.fields(F.col("b0"), B.COLD_WORD1))


@query("""SELECT l_orderkey, l_linenumber, CAST(188 | (1 << 8) | ((l_suppkey & 2047) << 13) | (CAST(l_linenumber AS BIGINT) << 24)
    | ((l_partkey & 4095) << 48) AS BIGINT) AS w0 FROM lineitem""")
def header_compose(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    word = B.compose(
        comma=(F.lit(COMMA), 0), version=(F.lit(1), 8), id=(F.col("l_suppkey").bitwiseAND(B.lit(2047)), 13), rsvd=(F.col("l_linenumber"), 24), errors=(F.col("l_partkey").bitwiseAND(B.lit(4095)), 48)
    )
    return rows.select("l_orderkey", "l_linenumber", word.alias("w0"))


@query(f"WITH {FRAMES}, x AS (SELECT link, k, (w0 >> 13) & 2047 AS id FROM frames) SELECT link, k, CAST((((id >> 3) & 31) << 6) | (((id >> 8) & 7) << 3) | (id & 7) AS BIGINT) AS csf FROM x")
def csf_reorder(spark, sf_dir):
    return frames(spark, sf_dir).select("link", "k", B.csf(B.field(F.col("w0"), *B.FRAME_HEADER["id"])).alias("csf"))


@query(f"""SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'wib' WHEN 1 THEN 'compressed' ELSE 'other' END AS record,
    CAST(CASE o_custkey % 3 WHEN 0 THEN o_orderkey & 2047 WHEN 1 THEN o_custkey & 2047 ELSE {UNKNOWN_SOURCE} END AS BIGINT) AS source FROM orders""")
def source_id_lookup(spark, sf_dir):
    """The word that names the source depends on the record type: word 0, word 1, or none."""
    rows, kind = table(spark, sf_dir, "orders"), F.col("o_custkey") % 3
    record = F.when(kind == 0, "wib").when(kind == 1, "compressed").otherwise("other")
    low = lambda c: F.col(c).bitwiseAND(B.lit(2047))
    return rows.select("o_orderkey", record.alias("record"), F.when(kind == 0, low("o_orderkey")).when(kind == 1, low("o_custkey")).otherwise(B.lit(UNKNOWN_SOURCE)).alias("source"))


@query("SELECT o_orderkey, CAST((t >> 28) & 15 AS BIGINT) AS frame_type, CAST((t >> 24) & 15 AS BIGINT) AS record_type, CAST(t & 16777215 AS BIGINT) AS nbytes, CAST((t >> 32) & 4294967295 AS BIGINT) AS status FROM (SELECT o_orderkey, o_orderkey * 2654435761 + o_custkey AS t FROM orders)")
def trailer_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 2654435761 + F.col("o_custkey")).alias("t"))
    return rows.select("o_orderkey", *B.fields(F.col("t"), B.TRAILER))


@query(f"""SELECT o_orderkey, CAST((o_custkey & 16777215) | (2 << 24) | (CAST(o_orderkey % 16 AS BIGINT) << 28) | (CAST(o_custkey % 4096 AS BIGINT) << 32) AS BIGINT) AS trailer0,
    CAST((CAST({TRAILER_PATTERN} AS BIGINT) << 32) | 16777216 AS BIGINT) AS trailer1 FROM orders""")
def trailer_compose(spark, sf_dir):
    first, second = B.trailer_words(F.col("o_custkey") % 4096, F.col("o_orderkey") % 16, F.lit(2), F.col("o_custkey").bitwiseAND(B.lit(16777215)), F.lit(16777216))
    return table(spark, sf_dir, "orders").select("o_orderkey", first.alias("trailer0"), second.alias("trailer1"))


@query(f"SELECT o_orderkey, {_extract('w', B.RECORD_HEADER0)}, CAST(~w AS BIGINT) AS trailer FROM (SELECT o_orderkey, o_orderkey * 1000003 + o_custkey * 17179869184 AS w FROM orders)")
def record_header(spark, sf_dir):
    """Header of a record, and the trailer that repeats it with every bit turned."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 1000003 + F.col("o_custkey") * 17179869184).alias("w"))
    return rows.select("o_orderkey", *B.fields(F.col("w"), B.RECORD_HEADER0), B.complement(F.col("w")).alias("trailer"))


@query(f"SELECT o_orderkey, {_extract('w', B.RECORD_HEADER1)} FROM (SELECT o_orderkey, o_orderkey * 1000003 + o_custkey * 17179869184 AS w FROM orders)")
def record_header_specific(spark, sf_dir):
    """Headers of the second and third kind: 32 bits are the type's own."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 1000003 + F.col("o_custkey") * 17179869184).alias("w"))
    return rows.select("o_orderkey", *B.fields(F.col("w"), B.RECORD_HEADER1))


@query(f"SELECT l_orderkey, l_linenumber, w, {_extract('w', B.STREAM_BRIDGE)} FROM (SELECT l_orderkey, l_linenumber, CAST(1 | ((l_suppkey & 4095) << 4) | (CAST(l_linenumber AS BIGINT) << 16) | ((l_partkey & 127) << 24) AS BIGINT) AS w FROM lineitem)")
def stream_bridge(spark, sf_dir):
    word = B.compose(format=(F.lit(1), 0), csf=(F.col("l_suppkey").bitwiseAND(B.lit(4095)), 4), left=(F.col("l_linenumber"), 16), status=(F.col("l_partkey").bitwiseAND(B.lit(127)), 24))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", word.alias("w")).select("l_orderkey", "l_linenumber", "w", *B.fields(F.col("w"), B.STREAM_BRIDGE))


@query("""WITH w AS (SELECT vec_id, CAST(floor((i - 1) / 16) AS BIGINT) AS part, (i - 1) % 16 AS slot, CAST(floor(2048 + 1000 * CAST(x AS DOUBLE)) AS BIGINT) AS adc
    FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))
    SELECT vec_id, part, array_to_string(list(adc ORDER BY slot), ',') AS adcs FROM w GROUP BY vec_id, part""")
def unpack_adc12(spark, sf_dir):
    """Sixteen samples packed into three words, and taken out again."""
    packed = _packed(spark, sf_dir)
    return packed.select("vec_id", "part", F.concat_ws(",", *[c.cast("string") for c in B.unpack_adcs([F.col("p0"), F.col("p1"), F.col("p2")])]).alias("adcs"))


def _packed(spark, sf_dir):
    adc = lambda i: F.floor(2048 + 1000 * F.get("x", i).cast("double")).cast("long")
    parts = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: F.slice("embedding", p * 16 + 1, 16)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", parts.alias("part", "x"))
    p = B.pack_adcs([adc(i) for i in range(16)])
    return rows.select("vec_id", F.col("part").cast("long").alias("part"), *[c.alias(f"p{i}") for i, c in enumerate(p)])


@query("""WITH w AS (SELECT vec_id, CAST(floor((i - 1) / 16) AS BIGINT) AS part, CAST((i - 1) % 16 AS INTEGER) AS slot, CAST(floor(2048 + 1000 * CAST(x AS DOUBLE)) AS BIGINT) AS adc
    FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
    byte AS (SELECT vec_id, part, slot // 4 AS g, sum(CASE slot % 4
        WHEN 0 THEN (adc & 255) + (adc >> 8) * 65536 WHEN 1 THEN (adc & 255) * 256 + (adc >> 8) * 16777216
        WHEN 2 THEN (adc & 15) * 1048576 + (adc >> 4) * 4294967296 ELSE (adc & 15) * 268435456 + (adc >> 4) * 1099511627776 END) AS v FROM w GROUP BY ALL)
    SELECT vec_id, part, CAST(sum(CASE g WHEN 1 THEN CAST(v AS BIGINT) >> 16 WHEN 2 THEN (CAST(v AS BIGINT) & 65535) * 4294967296 ELSE 0 END) & 281474976710655 AS BIGINT) AS p1_low48 FROM (
        SELECT vec_id, part, g, CAST(v AS BIGINT) AS v FROM byte) GROUP BY vec_id, part""")
def pack_adc12(spark, sf_dir):
    """The low 48 bits of the middle word of three."""
    return _packed(spark, sf_dir).select("vec_id", "part", B.field(F.col("p1"), 0, 48).alias("p1_low48"))


@query("SELECT o_orderkey, printf('%d.%d.%d.%d', (w >> 24) & 255, (w >> 16) & 255, (w >> 8) & 255, w & 255) AS version FROM (SELECT o_orderkey, o_orderkey * 65537 + o_custkey AS w FROM orders)")
def version_string(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.version_string(F.col("o_orderkey") * 65537 + F.col("o_custkey")).alias("version"))


@query("SELECT event_id, (1000 * us + 10) // 20 AS ticks FROM (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS us FROM events)")
def ticks_from_usec(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.ticks(F.floor(F.col("value") * 100).cast("long")).alias("ticks"))


@query("SELECT l_orderkey, l_linenumber, (n + 7) // 8 AS words, (n + 63) // 64 AS bit_words FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS BIGINT) AS n FROM (SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS l_extendedprice FROM lineitem))")
def round_words(spark, sf_dir):
    n = F.floor("l_extendedprice").cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", B.words_up(n, 8).alias("words"), B.words_up(n, 64).alias("bit_words"))


@query("SELECT o_orderkey, bof, bof + 1023 AS eof, idx, off FROM (SELECT o_orderkey, t - t % 1024 AS bof, t // 1024 AS idx, t % 1024 AS off FROM (SELECT o_orderkey, o_orderkey * 7919 AS t FROM orders))")
def packet_partition(spark, sf_dir):
    """Where a timestamp falls among packets of 1024: the packet's first and last tick, its number, the offset."""
    t = F.col("o_orderkey") * 7919
    return table(spark, sf_dir, "orders").select("o_orderkey", (t - t % 1024).alias("bof"), t.bitwiseOR(B.lit(1023)).alias("eof"), F.shiftright(t, 10).alias("idx"), (t % 1024).alias("off"))


@query("SELECT event_id, CAST(length(props) AS BIGINT) AS frame_size, event_id + 1 AS tx_sequence, (event_id * 31) % 4294967296 AS rx_sequence, user_id % 7 AS type_id FROM events")
def transport_header(spark, sf_dir):
    """Four little-endian 32-bit numbers, written to bytes and read from them."""
    values = [F.length("props"), F.col("event_id") + 1, (F.col("event_id") * 31) % 4294967296, F.col("user_id") % 7]
    raw = F.unhex(F.concat(*[B.swapped(F.lpad(F.hex(v.cast("long")), 8, "0"), 4) for v in values]))
    names = ("frame_size", "tx_sequence", "rx_sequence", "type_id")
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).select("event_id", *[B.little_endian(F.col("raw"), 4 * i).alias(n) for i, n in enumerate(names)])


_SPECS = [("low", 0, 255), ("middle", 8, 4095), ("high", 20, 7)]


@query(" UNION ALL ".join(f"SELECT o_orderkey, '{n}' AS variable, CAST((o_orderkey * 65537 + o_custkey) >> {b} & {m} AS BIGINT) AS value FROM orders" for n, b, m in _SPECS))
def register_fields(spark, sf_dir):
    """One register, many variables: a table of (variable, bit, mask) against registers."""
    specs = F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), F.lit(b).alias("bit"), B.lit(m).alias("mask")) for n, b, m in _SPECS]))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 65537 + F.col("o_custkey")).alias("register"), specs.alias("s"))
    return rows.select("o_orderkey", F.col("s.variable").alias("variable"), F.call_function("shiftright", "register", "s.bit").bitwiseAND(F.col("s.mask")).alias("value"))


@query("SELECT l_orderkey, CAST(bit_or((l_suppkey & 15) << (4 * (l_linenumber - 1))) AS BIGINT) AS register FROM lineitem GROUP BY l_orderkey")
def register_compose(spark, sf_dir):
    """Many variables, one register: OR of each value at its bit."""
    moved = F.call_function("shiftleft", F.col("l_suppkey").bitwiseAND(B.lit(15)), 4 * (F.col("l_linenumber") - 1))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bit_or(moved).alias("register"))


@query(f"WITH {STATUS} SELECT link, k, status FROM checked")
def status_flags(spark, sf_dir):
    return checked(spark, sf_dir).select("link", "k", "status")


@query(f"WITH {STATUS} SELECT link, k, status FROM checked WHERE (status >> 26) & 63 = 0")
def good_frames(spark, sf_dir):
    return checked(spark, sf_dir).filter(O.good()).select("link", "k", "status")


@query(f"WITH {STATUS} SELECT link, k FROM checked WHERE (status >> 24) & 3 = 0")
def drop_run_disabled(spark, sf_dir):
    return checked(spark, sf_dir).filter(O.promoted()).select("link", "k")


@query(f"WITH {STATUS} SELECT link, k, " + ", ".join(f"(status >> {a}) & {(1 << b) - 1} <> 0 AS {n}" for n, (a, b) in O.BAD_GROUPS.items()) + " FROM checked")
def header_bad_groups(spark, sf_dir):
    return checked(spark, sf_dir).select("link", "k", *[(B.field(F.col("status"), *at) != 0).alias(n) for n, at in O.BAD_GROUPS.items()])


@query(f"""WITH {STATUS}, m AS (SELECT link, k // {FRAMES_PER_PACKET} AS pkt, k, CAST({' + '.join(f'(CASE WHEN (status >> {a}) & {(1 << b) - 1} <> 0 THEN {1 << i} ELSE 0 END)' for i, (a, b) in enumerate(O.BAD_GROUPS.values()))} AS BIGINT) AS mask FROM checked)
    SELECT link, pkt, k % {FRAMES_PER_PACKET} AS frame, mask FROM (SELECT *, row_number() OVER (PARTITION BY link, pkt ORDER BY k) AS r FROM m WHERE mask <> 0) WHERE r <= 32""")
def first32_exceptions(spark, sf_dir):
    return O.exceptions(checked(spark, sf_dir), FRAMES_PER_PACKET)


@query(f"WITH {FRAMES} SELECT link, k, tick, coalesce(tick <> lag(tick) OVER (PARTITION BY link ORDER BY k) + 25, false) AS jump FROM frames")
def ts_continuity(spark, sf_dir):
    jump = F.col("tick") != F.col("prev.tick") + 25
    return R.previous(frames(spark, sf_dir), {"tick": F.col("tick")}).select("link", "k", "tick", F.coalesce(jump, F.lit(False)).alias("jump"))


@query(f"WITH {FRAMES}, c AS (SELECT link, k, (a0 >> 48) & 65535 AS convert FROM frames) SELECT link, k, convert, coalesce(convert <> ((lag(convert) OVER (PARTITION BY link ORDER BY k) + 1) & 65535), false) AS bad FROM c")
def convert_count_check(spark, sf_dir):
    convert = B.field(F.col("a0"), *B.COLD_WORD0["convert"])
    bad = convert != (F.col("prev.convert") + 1).bitwiseAND(B.lit(65535))
    return R.previous(frames(spark, sf_dir), {"convert": convert}).select("link", "k", convert.alias("convert"), F.coalesce(bad, F.lit(False)).alias("bad"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderkey) AS step FROM orders)
    SELECT o_custkey % 16 AS link, count(*) FILTER (step <> 1) AS gaps, CAST(coalesce(sum(step - 1) FILTER (step > 1), 0) AS BIGINT) AS missing FROM o GROUP BY o_custkey % 16""")
def seq_gaps(spark, sf_dir):
    link = (F.col("o_custkey") % 16).alias("link")
    rows = R.previous(table(spark, sf_dir, "orders").select(link, "o_orderkey"), {"key": F.col("o_orderkey")}, order="o_orderkey")
    rows = rows.withColumn("step", F.col("o_orderkey") - F.col("prev.key"))
    return rows.groupBy("link").agg(F.count_if(F.col("step") != 1).alias("gaps"), F.coalesce(F.sum(F.when(F.col("step") > 1, F.col("step") - 1)), F.lit(0)).alias("missing"))


@query(f"""WITH {FRAMES}, p AS (SELECT link, k, w0 & 255 AS comma, tick, (a0 >> 48) & 65535 AS c0, (a1 >> 48) & 65535 AS c1, lag(tick) OVER w AS t, lag((a0 >> 48) & 65535) OVER w AS p0, lag((a1 >> 48) & 65535) OVER w AS p1
    FROM frames WINDOW w AS (PARTITION BY link ORDER BY k))
    SELECT link, count(*) FILTER (comma <> 188) AS markers, count(*) FILTER (tick <> t + 25) AS ticks, count(*) FILTER (c0 <> ((p0 + 1) & 65535) OR c1 <> ((p1 + 1) & 65535)) AS converts FROM p GROUP BY link""")
def payload_continuity(spark, sf_dir):
    """Of each link, frames whose marker, timestamp or either convert count is not what the frame before predicts."""
    c = {f"c{n}": B.field(F.col(f"a{n}"), *B.COLD_WORD0["convert"]) for n in (0, 1)}
    off = [x != (F.col(f"prev.{n}") + 1).bitwiseAND(B.lit(65535)) for n, x in c.items()]
    rows = R.previous(frames(spark, sf_dir), {"tick": F.col("tick")} | c)
    rows = rows.select("link", (B.field(F.col("w0"), 0, 8) != COMMA).alias("m"), (F.col("tick") != F.col("prev.tick") + 25).alias("t"), (off[0] | off[1]).alias("c"))
    return rows.groupBy("link").agg(F.count_if("m").alias("markers"), F.count_if("t").alias("ticks"), F.count_if("c").alias("converts"))


@query("SELECT o_orderkey, n, n > 265000 AS oversized, n <> e AS short FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n, CAST(floor(o_totalprice) AS BIGINT) - (CASE WHEN o_custkey % 50 = 0 THEN 8 ELSE 0 END) AS e FROM orders) WHERE n > 265000 OR n <> e")
def size_sanity(spark, sf_dir):
    n = F.floor("o_totalprice").cast("long")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), (n - F.when(F.col("o_custkey") % 50 == 0, 8).otherwise(0)).alias("e"))
    return rows.select("o_orderkey", "n", (F.col("n") > 265000).alias("oversized"), (F.col("n") != F.col("e")).alias("short")).filter("oversized or short")


@query(f"SELECT event_id FROM (SELECT event_id, (CAST(CASE WHEN event_id % 11 = 0 THEN 1 ELSE {SYNC_PATTERN} END AS HUGEINT) << 40) + event_id AS header FROM events) WHERE (header >> 40) = {SYNC_PATTERN}")
def sync_pattern(spark, sf_dir):
    word = B.compose(sync=(F.when(F.col("event_id") % 11 == 0, 1).otherwise(SYNC_PATTERN), 40), rest=(F.col("event_id"), 0))
    return table(spark, sf_dir, "events").filter(B.field(word, 40, 24) == SYNC_PATTERN).select("event_id")


@query("SELECT user_id AS lane, event_id AS pos, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS resync FROM events")
def resync_marker(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("lane"), F.col("event_id").alias("pos"), (F.col("event_type") == "error").alias("is_marker"))
    return O.next_marker(rows).select("lane", "pos", "resync")


@query("SELECT lane, frame, count(*) AS symbols, min(pos) AS first, max(pos) AS last FROM (SELECT user_id AS lane, event_id AS pos, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS frame FROM events) GROUP BY lane, frame")
def frame_symbols(spark, sf_dir):
    """A lane's symbols in frames: each start symbol begins one."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("lane"), F.col("event_id").alias("pos"), (F.col("event_type") == "signup").alias("is_start"))
    return O.frame_symbols(rows).groupBy("lane", "frame").agg(F.count(F.lit(1)).alias("symbols"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query("""WITH s AS (SELECT user_id AS lane, event_id AS pos, event_type = 'signup' AS m, event_type = 'purchase' AS c FROM events),
    t AS (SELECT *, sum(CASE WHEN m THEN 1 ELSE 0 END) OVER (PARTITION BY lane ORDER BY pos ROWS UNBOUNDED PRECEDING) AS capture FROM s),
    u AS (SELECT *, row_number() OVER w - 1 AS i, sum(CASE WHEN c THEN 1 ELSE 0 END) OVER w AS closed FROM t WHERE capture > 0 WINDOW w AS (PARTITION BY lane, capture ORDER BY pos))
    SELECT lane, CAST(capture AS BIGINT) AS capture, i, pos FROM u WHERE i BETWEEN 1 AND 4 AND closed = 0""")
def spy_capture(spark, sf_dir):
    """Up to four words after a marker, fewer if a control word comes."""
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("lane"), F.col("event_id").alias("pos"), (kind == "signup").alias("is_marker"), kind.isin("signup", "purchase").alias("is_control"))
    return O.captures(rows, 4)


@query(f"WITH {KEPT} SELECT link, k, pkt, frame FROM kept")
def packetise(spark, sf_dir):
    return kept(spark, sf_dir).select("link", "k", "pkt", "frame")


@query(f"WITH {KEPT} SELECT link, pkt, min(tick) AS beg, arg_max(tick, frame) + 25 AS fin, count(*) AS frames FROM kept GROUP BY link, pkt")
def packet_time_range(spark, sf_dir):
    return O.packet_summary(kept(spark, sf_dir)).select("link", "pkt", F.col("first_tick").alias("beg"), (F.col("last_tick") + 25).alias("fin"), "frames")


@query(f"WITH {KEPT} SELECT link, pkt, bit_or(status) AS status FROM kept GROUP BY link, pkt")
def packet_status_or(spark, sf_dir):
    return O.packet_summary(kept(spark, sf_dir)).select("link", "pkt", "status")


@query(f"WITH {KEPT} SELECT link, pkt, arg_min(tick, frame) AS first_tick, arg_max(tick, frame) AS last_tick, arg_min(w0, frame) AS first_w0, arg_min(a0, frame) AS first_a0, arg_min(b0, frame) AS first_b0, arg_min(a1, frame) AS first_a1, arg_min(b1, frame) AS first_b1 FROM kept GROUP BY link, pkt")
def first_last_header(spark, sf_dir):
    """What a packet's first record keeps: seven header words."""
    return O.packet_summary(kept(spark, sf_dir)).select("link", "pkt", "first_tick", "last_tick", *[f"first_{c}" for c in ("w0", "a0", "b0", "a1", "b1")])


_SOUND = "(status >> 26) & 63 = 0 AND (status >> 25) & 1 = 0"


@query(f"""WITH {STATUS} SELECT link, count(*) AS frames, {", ".join(f"count(*) FILTER ((status >> 26) & 63 = 0 AND (status >> 24) & 3 = {s}) AS {n}" for s, n in enumerate(("normal", "disabled", "flushed", "disabled_flushed")))},
    count(*) FILTER ((status >> 26) & 1 = 1) AS sof_missing, {", ".join(f"count(*) FILTER ((status >> 26) & 1 = 0 AND (status >> {STATUS_BITS[n]}) & 1 = 1) AS {n}" for n in ("sof_unexpected", "eof_missing", "eof_unexpected", "eof_error"))},
    {", ".join(f"count(*) FILTER ({_SOUND} AND (status >> {b}) & 1 = 1) AS {n}" for n, b in STATUS_BITS.items() if b < 24)} FROM checked GROUP BY link""")
def read_counters(spark, sf_dir):
    return O.counters(checked(spark, sf_dir))


@query(f"WITH {KEPT}, p AS (SELECT link, pkt, count(*) * 240 + 16 AS nbytes FROM kept GROUP BY link, pkt), d AS (SELECT link, count(*) FILTER ((status >> 24) & 3 <> 0) AS dropped FROM checked GROUP BY link) SELECT link, count(*) AS packets, CAST(sum(nbytes) AS BIGINT) AS bytes, arg_max(nbytes, pkt) AS last_bytes, max(nbytes) AS max_bytes, max(dropped) AS dropped FROM p JOIN d USING (link) GROUP BY link")
def write_counters(spark, sf_dir):
    return O.write_counters(checked(spark, sf_dir, written=O.promoted), FRAMES_PER_PACKET)


@query(f"WITH {FRAMES}, e AS (SELECT link, k, tick, CASE WHEN k = 0 OR tick <> lag(tick) OVER w + 25 THEN tick END AS said FROM frames WINDOW w AS (PARTITION BY link ORDER BY k)) SELECT link, k, tick AS rebuilt FROM e")
def rebuild_headers(spark, sf_dir):
    """Timestamps from those alone that the frame before does not predict: all of them again."""
    rows = written(frames(spark, sf_dir).select("link", "k", "tick"), "ticks")
    rows = R.previous(rows, {"tick": F.col("tick")})
    said = F.when(F.col("prev").isNull() | (F.col("tick") != F.col("prev.tick") + 25), F.col("tick"))
    return O.rebuild_headers(rows.select("link", "k", said.alias("tick"))).select("link", "k", "rebuilt")


@query(f"WITH {FRAMES}, b AS (SELECT link, k, w0 + (CASE WHEN event_id % 40 = 0 THEN 1 ELSE 0 END) AS w FROM frames WHERE event_id % 61 <> 0) SELECT link, k, f.w0 AS expected, b.w AS actual FROM frames f LEFT JOIN b USING (link, k) WHERE f.w0 IS DISTINCT FROM b.w")
def stream_diff(spark, sf_dir):
    rows = frames(spark, sf_dir)
    changed = rows.filter("event_id % 61 <> 0").select("link", "k", (F.col("w0") + F.when(F.col("event_id") % 40 == 0, 1).otherwise(0)).alias("word"))
    return O.mismatches(rows.select("link", "k", F.col("w0").alias("word")), changed)


@query(f"WITH {FRAMES} SELECT l.link // 2 AS pair, l.k, CAST(l.w0 & 255 AS BIGINT) AS comma0, CAST(r.w0 & 255 AS BIGINT) AS comma1, l.tick AS tick0, r.tick AS tick1 FROM frames l JOIN frames r ON l.k = r.k AND l.link % 2 = 0 AND r.link = l.link + 1")
def dual_stream_merge(spark, sf_dir):
    """Frames of one number of two links, 2i and 2i + 1, in one row, for all pairs: one grouping by pair and number."""
    side = F.col("link") % 2
    of = lambda n, c: F.max(F.when(side == n, c))
    rows = frames(spark, sf_dir).groupBy(S.floor_div(F.col("link"), 2).alias("pair"), "k").agg(
        *[of(n, B.field(F.col("w0"), 0, 8)).alias(f"comma{n}") for n in (0, 1)], *[of(n, F.col("tick")).alias(f"tick{n}") for n in (0, 1)]
    )
    return rows.filter("tick0 is not null and tick1 is not null")


@query(f"""WITH {FRAMES}, c AS (SELECT link, k, (a0 >> 48) & 65535 AS convert FROM frames) SELECT link, k, CAST(convert AS BIGINT) AS convert FROM c""")
def rebuild_converts(spark, sf_dir):
    """Convert counts from those alone that the frame before does not predict: all of them again."""
    rows = written(frames(spark, sf_dir).select("link", "k", B.field(F.col("a0"), *B.COLD_WORD0["convert"]).alias("convert")), "converts")
    rows = R.previous(rows, {"convert": F.col("convert")})
    said = F.when(F.col("prev").isNull() | (F.col("convert") != (F.col("prev.convert") + 1).bitwiseAND(B.lit(65535))), F.col("convert"))
    return O.rebuild_headers(rows.select("link", "k", said.alias("convert"))).select("link", "k", F.col("rebuilt_convert").alias("convert"))


@query(f"""WITH {FRAMES} SELECT link, k, sof_bits & 1 = 0 AS sof_missing, sof_bits >> 1 <> 0 AS sof_unexpected, eof_bits >> 29 = 0 AS eof_missing, eof_bits & 536870911 <> 0 AS eof_unexpected FROM frames
    WHERE sof_bits <> 1 OR eof_bits <> 536870912""")
def framing_check(spark, sf_dir):
    """Frames whose start and end marks are not where they belong, and what is wrong with them."""
    found = O.framing(F.col("sof_bits"), F.col("eof_bits"))
    return frames(spark, sf_dir).select("link", "k", *[c.alias(n) for n, c in found.items()]).filter(" or ".join(found))


@query(f"""WITH {STATUS}, e AS (SELECT link, k, status, sum(CASE WHEN (status >> 26) & 63 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY link ORDER BY k ROWS UNBOUNDED PRECEDING) - (CASE WHEN (status >> 26) & 63 <> 0 THEN 1 ELSE 0 END) AS before FROM checked)
    SELECT link, k, status FROM e WHERE before < 3""")
def stop_after_errors(spark, sf_dir):
    """What a reader takes that stops at the third frame with a framing error."""
    return O.until_errors(checked(spark, sf_dir, errors=O.failed), 3, O.failed(), total="errors").select("link", "k", "status")


@query("SELECT event_id, (1000 * us + 10) // 20 AS ticks, ((1000 * us + 10) // 20) // 25600 AS pkt, CAST(((1000 * us + 10) // 20) % 25600 AS BIGINT) AS at FROM (SELECT event_id, epoch_us(ts) AS us FROM events)")
def ticks_since_epoch(spark, sf_dir):
    """Ticks of 20 ns since 1970, beyond what doubles hold exactly, and the packet of 1024 samples that each falls in."""
    ticks = S.ticks(F.unix_micros(F.col("ts").cast("timestamp")))
    rows = table(spark, sf_dir, "events").select("event_id", ticks.alias("ticks"))
    return rows.select("event_id", "ticks", S.floor_div(F.col("ticks"), 25600).alias("pkt"), F.pmod("ticks", F.lit(25600)).cast("long").alias("at"))


@query("SELECT user_id AS lane, event_id AS pos, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events WHERE event_type <> 'view'")
def word_commit(spark, sf_dir):
    """Written words have an index of their own; others are passed over."""
    idx = F.row_number().over(Window.partitionBy("lane").orderBy("pos")).cast("long") - 1
    return table(spark, sf_dir, "events").filter("event_type <> 'view'").select(F.col("user_id").alias("lane"), F.col("event_id").alias("pos")).withColumn("idx", idx)


@query(f"""WITH {STATUS}, q AS (SELECT link, k, status, k // 16 AS burst, sum(CASE WHEN (status >> 30) & 1 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY link, k // 16 ORDER BY k ROWS UNBOUNDED PRECEDING) AS failed FROM checked)
    SELECT link, burst, count(*) FILTER (failed = 0) AS moved, count(*) FILTER (failed > 0) AS blown FROM q GROUP BY link, burst""")
def drop_after_error(spark, sf_dir):
    """A burst of sixteen frames ends at its first error; the rest of it is discarded."""
    w = Window.partitionBy("link", "burst").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = checked(spark, sf_dir).withColumn("burst", S.floor_div(F.col("k"), 16)).withColumn("failed", F.sum(O.has("eof_error").cast("int")).over(w))
    return rows.groupBy("link", "burst").agg(F.count_if(F.col("failed") == 0).alias("moved"), F.count_if(F.col("failed") > 0).alias("blown"))


@query(" UNION ALL ".join(f"SELECT CAST(k AS BIGINT) AS k, 3840 AS adc0, {s} AS sof, {r} AS run_enable, {f} AS flush, {w} AS words FROM range(4) t(k)" for s, r, f, w in (("true", "false", "false", 30), ("true", "true", "true", 30), ("true", "false", "true", 30), ("false", "true", "false", 0))))
def flag_frames(spark, sf_dir):
    """Disabled, flush, disabled flush and empty frames."""
    kinds = [dict(run_enable=False), dict(flush=True), dict(run_enable=False, flush=True), dict(empty=True)]
    out = frame_rows(spark, 4, **kinds[0])
    for k in kinds[1:]:
        out = out.unionByName(frame_rows(spark, 4, **k))
    return out


@query(f"""WITH {FRAMES} SELECT link AS lane, k * 130 + event_id % 5 AS start, event_id % 19 = 0 OR event_id % 29 = 0 AS length_error, event_id % 23 = 0 AND NOT (event_id % 19 = 0 OR event_id % 29 = 0) AS crc_error,
    event_id % 19 = 0 OR event_id % 29 = 0 OR event_id % 23 = 0 AS eof_error, CAST(list_sum([(event_id * 31 + i * 7) % 65536 for i in range(1, 120)]) + 188 - (CASE WHEN event_id % 29 = 0 THEN (event_id * 31 + 350) % 65536 - 188 ELSE 0 END) AS BIGINT) AS total FROM frames WHERE event_id % 31 <> 0""")
def link_frames(spark, sf_dir):
    """Frames of a link's symbols: starts found past damage, 120 words taken, checksum and idle checked. Some frames hold a wrong symbol, a
    start among their words or a wrong checksum, and some are cut."""
    e = F.col("event_id")
    word = lambda i: F.when(i == 0, COMMA).when((i == 50) & (e % 29 == 0), COMMA).otherwise((e * 31 + i * 7) % 65536)
    words = F.transform(F.sequence(F.lit(0), F.lit(L.WORDS - 1)), word)
    crc = F.crc32(F.unhex(F.array_join(F.transform("words", lambda w: B.digits_of(w, 2)), "")))
    rows = frames(spark, sf_dir).select("link", "event_id", (F.col("k") * 130 + e % 5).alias("at"), words.alias("words")).withColumn("crc", crc + F.when(e % 23 == 0, 1).otherwise(0))
    ends = F.array(F.col("crc").bitwiseAND(B.lit(0xFFFF)), F.shiftright("crc", 16), B.lit(L.IDLE))
    sent = F.slice(F.concat("words", ends), 1, F.when(e % 31 == 0, 40).otherwise(L.SYMBOLS))
    rows = rows.select(F.col("link").alias("lane"), "event_id", "at", F.posexplode(sent).alias("n", "word"))
    n = F.col("n")
    control = F.when(n == 0, 1).when((n == 50) & (e % 29 == 0), 1).when((n == 7) & (e % 19 == 0), 2).when(n == L.SYMBOLS - 1, 3).otherwise(0)
    symbols = rows.select("lane", (F.col("at") + n).alias("pos"), "word", control.alias("control"), F.lit(True).alias("valid"))
    total = F.aggregate("words", B.lit(0), lambda s, w: s + w)
    return L.received(symbols).select("lane", "start", "length_error", "crc_error", "eof_error", total.alias("total"))
