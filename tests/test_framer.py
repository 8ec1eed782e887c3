import itertools
import random
import re
import struct
import zlib

from pyspark.sql import functions as F

from tallywire.operators import framer


def _plain(symbols):
    """A receiver, symbol by symbol: the frames of one lane as (start, symbols)."""
    at = {p: (w, c, v) for p, w, c, v in symbols}
    out, free = [], None
    for p in sorted(at):
        w, c, v = at[p]
        if (free is None or p >= free) and v and c == 1 and w & 0xFF == 0xBC:
            free = p + 123
            out.append((p, [at.get(p + i) for i in range(123)]))
    return out


def _frame(rng, good=True):
    words = [(rng.randrange(256) << 8 | 0xBC, 1)] + [(rng.randrange(65536), 0) for _ in range(119)]
    crc = zlib.crc32(struct.pack("<120H", *(w for w, _ in words)))
    words += [(crc & 0xFFFF, 0), (crc >> 16, 0), (framer.IDLE, 3)]
    if not good:
        i = rng.randrange(1, 123)
        words[i] = rng.choice([(words[i][0] ^ 1, words[i][1]), (0x00BC, 1), (words[i][0], 2)])
    return words


def test_frames_of_symbols(spark, monkeypatch):
    monkeypatch.setattr(framer, "FAN", 3)
    rng, rows = random.Random(3), []
    for lane in (0, 1, None):
        p = rng.randrange(50)
        for _ in range(60):
            for w, c in [(framer.IDLE, 3)] * rng.choice([0, 0, 3, 150]) + _frame(rng, rng.random() < 0.6)[: rng.choice([123, 123, 123, 40])]:
                rows.append((lane, p, w, c, rng.random() > 0.001))
                p += 1
            if rng.random() < 0.05:
                p += rng.choice([1, 700])  # a gap
    df = spark.createDataFrame(rows, "lane int, pos long, word int, control int, valid boolean").withColumn("i", F.lit(5)).repartition(3)
    for block in (256, 1000, 1 << 14):
        placed = framer.place(df, block=block)
        got = {(r.lane, r.start): r for r in framer.framed(placed).collect()}
        want = {(lane, s): f for lane in (0, 1, None) for s, f in _plain([r[1:] for r in rows if r[0] == lane]) if None not in f}
        assert got.keys() == want.keys(), block
        for at, f in want.items():
            wrong = any(not v or c for _, c, v in f[1:122]) or f[122] != (framer.IDLE, 3, True)
            crc = zlib.crc32(struct.pack("<120H", *(w for w, _, _ in f[:120]))) == f[120][0] | f[121][0] << 16
            r = got[at]
            assert (r.words, r.length_error, r.crc_error, r.eof_error) == ([w for w, _, _ in f[:120]], wrong, not wrong and not crc, wrong or not crc)
        assert placed.count() == len(rows)
    assert any(r.crc_error for r in got.values()) and any(r.length_error for r in got.values()) and not all(r.eof_error for r in got.values())
    assert framer.framed(framer.place(df.limit(0))).count() == 0


def test_received_is_what_is_placed_and_framed(spark, monkeypatch):
    """Frames straight from symbols, whole ones and those that blocks cut, damaged and with gaps; blocks hand on no symbols."""
    monkeypatch.setattr(framer, "FAN", 3)
    rng, rows = random.Random(8), []
    for lane in (None, 1):
        symbols = [s for _ in range(30) for s in [(framer.IDLE, 3)] * rng.choice([0, 3, 150]) + _frame(rng, rng.random() < 0.6)[: rng.choice([123, 123, 40])]]
        rows += [(lane, p, w, c, rng.random() > 0.0005) for p, (w, c) in enumerate(symbols) if rng.random() > 0.0003]
    df = spark.createDataFrame(rows, "lane long, pos long, word long, control int, valid boolean")
    plain = lambda f: sorted(map(tuple, f.collect()), key=repr)
    for block in (64, 1000):
        got = plain(framer.received(df, block=block))
        want = plain(framer.framed(framer.place(df, block=block)))
        assert got
        assert got == want, [(a[:2], a[3:], b[:2], b[3:]) for a, b in zip(got, want, strict=False) if a != b][:3]


def test_symbols_and_maps_are_not_broadcast(spark, sf):
    """Symbols that are exploded from a small table look small to the planner, yet they are the whole job."""
    from tallywire.plans.frames import link_frames

    plan = link_frames(spark, sf)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(re.match(r"[ :|+-]*", line)[0])
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = list(itertools.takewhile(lambda x, top=depth(line): depth(x) > top, plan[i + 1 :]))
            assert not [x for x in below if "Generate" in x or "FlatMapGroupsInArrow" in x], line
    assert any("Generate" in line for line in plan)
