import itertools
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from tallywire.functions import bits as B
from tallywire.functions import scalars as S
from tallywire.operators import frames, ranges, triggers
from tallywire.schema import STATUS_BITS
from tallywire.sources.text import hex_records


def test_pack_unpack(spark):
    rng = random.Random(1)
    rows = [tuple(rng.randrange(4096) for _ in range(16)) for _ in range(50)] + [(0,) * 16, (4095,) * 16]
    names = [f"c{i}" for i in range(16)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    packed = df.select("*", *[c.alias(f"w{i}") for i, c in enumerate(B.pack_adcs([F.col(n) for n in names]))])
    got = packed.select(*names, *[c.alias(f"u{i}") for i, c in enumerate(B.unpack_adcs([F.col(f"w{i}") for i in range(3)]))]).collect()
    assert all(r[:16] == r[16:] for r in got)


def test_zigzag(spark):
    df = spark.range(-50, 50).select("id", B.unzigzag(B.zigzag(F.col("id"))).alias("again"))
    assert df.filter("id <> again").count() == 0


def test_fields_of_all_bits(spark):
    r = spark.range(1).select(*B.fields(F.lit(-1).cast("long"), B.FRAME_HEADER), *B.fields(F.lit(-1).cast("long"), B.TRAILER)).first()
    assert r.asDict() == {"comma": 255, "version": 31, "id": 2047, "rsvd": 0xFFFFFF, "errors": 0xFFFF, "nbytes": 0xFFFFFF, "record_type": 15, "frame_type": 15, "status": 0xFFFFFFFF}


GOOD = dict(comma=0xBC, version=1, id=5, errors=0, run_enable=True, flush=False, sof=1, eof=1 << 29, eof_error=False)


def _frames(spark, rows):
    made = []
    for k, change in enumerate(rows):
        r = GOOD | dict(tick=1000 + 25 * k, convert=(65534 + k) & 0xFFFF, hdrs=3, e1=0, reg=0) | change
        w0 = r["comma"] | r["version"] << 8 | r["id"] << 13 | r["errors"] << 48
        a = r["e1"] | r["convert"] << 48
        a -= (1 << 64) if a >> 63 else 0
        b = r["reg"] | r["hdrs"] << 32
        made.append((0, k, w0, r["tick"], a, b, a, b, r["sof"], r["eof"], r["eof_error"], r["run_enable"], r["flush"]))
    return spark.createDataFrame(made, "link long, k long, w0 long, tick long, a0 long, b0 long, a1 long, b1 long, sof_bits long, eof_bits long, eof_error boolean, run_enable boolean, flush boolean")


def test_status_bits(spark):
    """One change each: the bit it sets, and no bit where a counter wraps from 65535 to 0."""
    changes = [{}, {}, {}, dict(comma=1), dict(version=2), dict(id=6), dict(errors=1), {}, dict(e1=3), dict(reg=1), dict(run_enable=False), dict(flush=True), dict(sof=0), dict(sof=3), dict(eof=0), dict(eof=1 << 29 | 1), dict(eof_error=True)]
    got = {r.k: r.status for r in frames.status(_frames(spark, changes)).collect()}
    bit = lambda *names: sum(1 << STATUS_BITS[n] for n in names)
    want = [0, 0, 0, bit("bad_comma"), bit("bad_version"), bit("bad_id"), bit("bad_errors"), 0, bit("cd0_stream_err1", "cd1_stream_err1"), bit("cd0_err_reg", "cd1_err_reg")]
    want += [bit("run_disable"), bit("flush"), bit("sof_missing"), bit("sof_unexpected"), bit("eof_missing"), bit("eof_unexpected"), bit("eof_error")]
    assert [got[k] for k in range(len(want))] == want


def test_jumps(spark):
    got = {r.k: r.status for r in frames.status(_frames(spark, [{}, dict(tick=9999), {}, dict(convert=7), {}, dict(hdrs=4), {}])).collect()}
    names = [[n for n, b in STATUS_BITS.items() if got[k] >> b & 1] for k in range(7)]
    assert names == [[], ["bad_timestamp"], ["bad_timestamp"], ["cd0_convert", "cd1_convert"], ["cd0_convert", "cd1_convert"], ["cd0_hdrs", "cd1_hdrs"], ["cd0_hdrs", "cd1_hdrs"]]


def test_first_frame_masks(spark):
    df = _frames(spark, [dict(flush=True, comma=1)])
    assert frames.status(df).first().status == 1
    assert frames.status(df, first_mask="intended").first().status == 1 | 1 << STATUS_BITS["flush"]


def test_interval_join(spark):
    """Against all pairs; buckets of every size give each pair once."""
    rng = random.Random(2)
    trg = [(i, rng.randrange(1000)) for i in range(40)]
    pkt = [(i, b, b + rng.randrange(1, 120)) for i, b in enumerate(rng.randrange(1000) for _ in range(60))]
    t, p = spark.createDataFrame(trg, "trg_id long, t0 long"), spark.createDataFrame(pkt, "pkt long, beg long, fin long")
    want = sorted((i, j) for (i, t0), (j, b, f) in itertools.product(trg, pkt) if b < t0 - 30 + 50 and f > t0 - 30)
    for span in (1, 7, 50, 5000):
        assert sorted((r.trg_id, r.pkt) for r in triggers.in_window(t, p, 30, 50, span=span).collect()) == want


def test_interval_join_of_long_packets(spark):
    """Packets of all lengths against a short window: each pair once, and no packet in more than some dozens of buckets."""
    rng = random.Random(5)
    trg = [(i, rng.randrange(10**6)) for i in range(50)]
    pkt = [(i, b, b + rng.choice([1, 40, 3000, 10**5, 10**7])) for i, b in enumerate(rng.randrange(10**6) for _ in range(80))]
    t, p = spark.createDataFrame(trg, "trg_id long, t0 long"), spark.createDataFrame(pkt, "pkt long, beg long, fin long")
    want = sorted((i, j) for (i, t0), (j, b, f) in itertools.product(trg, pkt) if b < t0 + 30 and f > t0 - 20)
    assert sorted((r.trg_id, r.pkt) for r in triggers.in_window(t, p, 20, 50).collect()) == want


def test_interval_plan(spark):
    t, p = spark.range(3).select(F.col("id").alias("trg_id"), F.col("id").alias("t0")), spark.range(3).select(F.col("id").alias("beg"), (F.col("id") + 1).alias("fin"))
    plan = triggers.in_window(t, p, 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hex_records(spark):
    lines = [":020000040001F9", ":0400100001020304E2", ":00000001FF", ":0400100001020304E3", "no record"]
    rows = {r.line_no: r for r in hex_records(spark.createDataFrame(list(enumerate(lines)), "line_no long, text string")).collect()}
    assert rows[1].address == 0x10010 and rows[1].data == "01020304" and rows[1].sound
    assert rows[2].type == 1 and rows[2].sound and not rows[3].sound and 4 not in rows


def test_scalars(spark):
    r = spark.range(1).select(
        S.ticks(F.lit(1)).alias("ticks"), S.version_string(F.lit(0x01020304).cast("long")).alias("v"), S.parse_int(F.lit("0x1F")).alias("h"),
        S.parse_int(F.lit("0b101")).alias("b"), S.number_or_zero(F.lit("x")).alias("z"), S.rce_index(F.lit(2), F.lit(1), F.lit(2)).alias("rce"),
        S.sign_extend(F.lit(4095), 12).alias("s"), S.path_parts(F.lit("a:b(3):c")).alias("p"), B.bit_length(F.lit(0).cast("long")).alias("l0"), B.bit_length(F.lit(255).cast("long")).alias("l8"),
    ).first()
    assert (r.ticks, r.v, r.h, r.b, r.z, r.rce, r.s, r.l0, r.l8) == (50, "1.2.3.4", 31, 5, 0, 11, -1, 0, 8)
    assert [tuple(x) for x in r.p] == [("a", None), ("b", 3), ("c", None)]


def test_empty(spark):
    """Empty inputs give empty results."""
    df = _frames(spark, [{}]).filter("false")
    assert frames.packetise(frames.status(df), 4).count() == 0
    assert frames.exceptions(frames.status(df), 4).count() == 0


def test_ranges_against_plain_windows(spark):
    """What goes on over the ends of ranges, for null keys, gaps and an empty table."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), k, rng.randrange(100)) for k in rng.sample(range(400), 150)]
    df = spark.createDataFrame(rows, "link long, k long, v long")
    got = ranges.previous(df, {"v": F.col("v")}, by=ranges.by_number("k", 16))
    got = ranges.running_sum(got, F.col("v"), out="total", by=ranges.by_number("k", 7))
    got = ranges.first_of(ranges.numbered(got, out="number"), {"v0": F.col("v")})
    for r in got.collect():
        before = sorted((k, v) for link, k, v in rows if link == r.link and k < r.k)
        assert (r.prev.v if r.prev else None) == (before[-1][1] if before else None)
        assert (r.total, r.number, r.v0) == (sum(v for _, v in before) + r.v, len(before), before[0][1] if before else r.v)
    assert got.count() == len(rows) and set(got.columns) == {"link", "k", "v", "prev", "total", "number", "v0"}
    assert ranges.numbered(df.limit(0), out="number").collect() == []


def _exchanges(df):
    """Of the plan as it is before anything runs: scans, and the columns of each exchange."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?:FileScan|Scan parquet|Scan ExistingRDD)", plan)), re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan), plan


def test_frames_are_dealt_out_once(spark, sf):
    """Two scans, one for the small rows of ranges and one for frames; frames move once, by link and range, and only small rows by the
    link alone."""
    from tallywire import catalogue

    small = ["_key, _range", "_of"]  # grouped by range, then windowed by link
    more = {"status_flags": 0, "good_frames": 0, "packetise": 0, "stop_after_errors": 0, "read_counters": 1, "packet_status_or": 1, "write_counters": 2}
    for limit in ("10MB", "-1"):  # small rows are broadcast, or moved to the rows
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            for name, groups in more.items():
                scans, by, plan = _exchanges(catalogue.QUERIES[name](spark, sf))
                by = sorted(re.sub(r"#\d+L?", "", c) for c in by)
                assert scans == 2, (name, plan)
                moved = [c for c in by if c not in ("link", "link, pkt", "link, _groupingexpression")]
                assert sorted(small + ["_key, _range"] + (["_of, _at"] if limit == "-1" else [])) == moved and len(by) == len(moved) + groups, (name, by)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    frame = _frames(spark, [{}] * 40)
    for df in (frames.status(frame), frames.packetise(frames.status(frame), 4)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        for window in re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan):
            assert "_range" in window or "_of" in window, window


def test_known_values_are_carried(spark):
    """The last value that is not null, over the ends of ranges."""
    rng = random.Random(8)
    rows = [(rng.choice([1, None]), k, rng.choice([None, None, None, k * 3])) for k in range(200)]
    df = spark.createDataFrame(rows, "link long, k long, v long")
    for r in ranges.carried(df, by=ranges.by_number("k", 16), known={"last": F.col("v")}).collect():
        said = [(v, k) for link, k, v in rows if link == r.link and k <= r.k and v is not None]
        assert (tuple(r.last) if r.last else None) == (said[-1] if said else None)


def test_whole_division(spark):
    """Right for all of 64 bits, and rounded down below zero."""
    values = [1700000000123457, 2**62, -1, -40, -41, 0, 9007199254740993]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [r[0] for r in df.select(S.floor_div(F.col("v"), 20)).collect()] == [v // 20 for v in values]
    assert df.filter("v = 1700000000123457").select(S.ticks(F.col("v"))).first()[0] == 85000000006172850


def test_strings_as_words(spark):
    df = spark.createDataFrame([("",), ("abc",), ("abcd",), ("é",), ("x" * 33,), (None,)], "t string")
    rows = df.select("t", S.string_words(F.col("t")).alias("w"), S.words_string(S.string_words(F.col("t"))).alias("again")).collect()
    for r in rows:
        assert r.again == r.t
        if r.t is not None:
            data = r.t.encode() + b"\0" * (4 - len(r.t.encode()) % 4)
            assert r.w == list(struct.unpack(f"<{len(data) // 4}I", data))


@pytest.mark.parametrize("name", ["toc_offsets", "toc_pack_pairs", "toc_entries", "running_max_bytes"])
def test_lines_of_an_order_are_sorted_once(spark, sf, name):
    """A task holds one sort of its lines, and no table of their groups."""
    from tallywire import catalogue

    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan
