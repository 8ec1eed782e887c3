import random
import struct

from pyspark.sql import functions as F

from tallywire.operators import packets as P
from tallywire.schema import TRAILER_PATTERN


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_copy_packet_bytes(spark):
    rng = random.Random(2)
    frames = {(link, pkt): [[rng.getrandbits(64) for _ in range(30)] for _ in range(rng.randrange(1, 5))] for link in (1, None) for pkt in range(2)}
    rows = [(link, pkt, f, 1 << f, [_signed(w) for w in words]) for (link, pkt), all_ in frames.items() for f, words in enumerate(all_)]
    rng.shuffle(rows)
    made = P.copy_payloads(spark.createDataFrame(rows, "link long, pkt long, frame long, status long, words array<long>"))
    for r in made.collect():
        all_ = frames[r.link, r.pkt]
        body = b"".join(struct.pack("<30Q", *w) for w in all_)
        status = sum(1 << f for f in range(len(all_)))
        n = len(body) + 16
        assert bytes(r.payload) == body + struct.pack("<QQ", n | P.COPY << 24 | status << 32, 0x01000000 | TRAILER_PATTERN << 32)
    read = {(r.link, r.pkt, r.frame): r for r in P.copied_frames(made.select("link", "pkt", "payload")).collect()}
    assert {k: r.words for k, r in read.items()} == {(link, pkt, f): w for link, pkt, f, _, w in rows} and all(r.sound for r in read.values())


def test_unsound_packets(spark):
    frames = spark.createDataFrame([(1, 0, f, 0, list(range(30))) for f in range(2)], "link long, pkt long, frame long, status long, words array<long>")
    whole = bytes(P.copy_payloads(frames).first().payload)
    bad = [whole[:-8], whole[8:], whole[:-1], b"", None, whole[:-4] + b"abcd", whole[:8] + whole]
    got = P.copied_frames(spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "i int, payload binary")).collect()
    assert len(got) == len(bad) and not any(r.sound for r in got) and all(r.frame is None and r.words is None for r in got)


def test_channel_packet(spark):
    rng = random.Random(3)
    rows = [(p, ch, [rng.randrange(65536) for _ in range(rng.choice([0, 1, 3, 64]))]) for p in range(4) for ch in range(p + 1)]
    made = P.channel_payloads(spark.createDataFrame(rows, "pkt long, ch int, adcs array<int>"), keys=("pkt",))
    got = P.channel_blocks(made)
    assert {(r.pkt, r.ch): r.adcs for r in got.collect()} == {(p, ch): a for p, ch, a in rows} and got.filter("sound").count() == len(rows)
    raw = {r.pkt: bytes(r.payload) for r in made.collect()}
    table = {p: [struct.unpack_from("<I", raw[p], len(raw[p]) - 16 - 8 * ((p + 3) // 2 + 1) + 4 * i)[0] for i in range(p + 2)] for p in raw}
    for p, offsets in table.items():
        sizes = [len(a) for q, _, a in rows if q == p]
        assert offsets == [16 * sum(sizes[:i]) for i in range(len(sizes) + 1)]
    # an offset that does not rise, and a table of another number of channels
    at = len(raw[3]) - 16 - 8 * 4
    turned = raw[3][: at + 4] + struct.pack("<I", 1 << 30) + raw[3][at + 8 :]
    bad = spark.createDataFrame([(turned, [0, 1, 2, 3]), (raw[3], [0, 1]), (None, [1]), (b"x" * 24, [1])], "payload binary, channels array<long>")
    assert [(r.sound, r.adcs) for r in P.channel_blocks(bad).collect()] == [(False, None)] * 4


def test_headers_rebuilt_or_lost(spark):
    """From every word's own last kept value; counts wrap at 65536; with more than 32 exceptions the rest is lost."""
    rng = random.Random(4)
    frames = []
    for pkt, often in enumerate([0, 0.05, 0.1, 0.6]):
        w = [7, 1000, 65530 << 48 | 5, 9, 32760 << 48, 1]
        for f in range(100):
            frames.append((1, pkt, f, 1, *[_signed(x) for x in w]))
            w = [w[0], w[1] + 25, (w[2] + (1 << 48)) % (1 << 64), w[3], (w[4] + (1 << 48)) % (1 << 64), w[5]]
            if rng.random() < often:
                for i in rng.sample(range(6), rng.randint(1, 3)):
                    w[i] = rng.getrandbits(60)
    rng.shuffle(frames)
    df = spark.createDataFrame(frames, "link long, pkt long, frame long, status long, w0 long, tick long, a0 long, b0 long, a1 long, b1 long")
    records = P.header_records(df)
    got = P.rebuilt_frames(records.select("link", "pkt", F.lit(0).alias("lost_column"), "record"))
    rows = {(r.pkt, r.frame): r for r in got.collect()}
    assert len(rows) == len(frames)
    for _, pkt, f, _, *words in frames:
        r = rows[pkt, f]
        assert r.lost or [r[w] for w in P.HEADERS] == words
        assert not r.lost or all(r[w] is None for w in P.HEADERS)
    lost = {pkt: sum(r.lost for (p, _), r in rows.items() if p == pkt) for pkt in range(4)}
    assert lost[0] == lost[1] == 0 and 0 < lost[3] < 100
    sizes = {r.pkt: len(r.record) for r in records.collect()}
    assert sizes[0] == 8 * 9 and sizes[0] < sizes[1] < sizes[3]


def test_words_of_copy_packets_are_not_taken_out_one_by_one(spark):
    """Frames are written and read as bytes: the plans have no digits of a word, whatever a frame holds."""
    rows = [(1, 0, f, f, [f * 40 + i - 7 for i in range(30)]) for f in (2, 0, 1)] + [(2, 0, 0, 4, None), (2, 0, 1, 0, [None] + [-(1 << 63)] * 30)]
    made = P.copy_payloads(spark.createDataFrame(rows, "link long, pkt long, frame long, status long, words array<long>"))
    read = P.copied_frames(made.select("link", "pkt", "payload"))
    for df in (made, read):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "transform(words" not in plan
    got = sorted((r.link, r.frame, r.sound, r.status, r.words) for r in read.collect())
    assert got == [(1, f, True, 3, [f * 40 + i - 7 for i in range(30)]) for f in range(3)] + [(2, 0, True, 4, [-(1 << 63)] * 30)]


def test_frames_of_a_packet_are_joined_as_bytes(spark):
    """The digits of frames are not written and read again; frames without words have no bytes, wherever they stand."""
    rows = [(1, p, f, 1, None if (p + f) % 3 == 0 else [100 * p + f, -1]) for p in range(4) for f in range(5)] + [(2, 0, 0, 1, None)]
    made = P.copy_payloads(spark.createDataFrame(rows, "link long, pkt long, frame long, status long, words array<long>"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and "transform(" not in plan
    for r in made.collect():
        words = [w for link, p, _, _, ws in rows if (link, p) == (r.link, r.pkt) for w in ws or []]
        assert bytes(r.payload)[:-16] == struct.pack(f"<{len(words)}q", *words) and r.frames == (5 if r.link == 1 else 1)
