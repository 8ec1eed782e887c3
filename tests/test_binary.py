import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywire.schema import LARGEST_MESSAGE, TRAILER_PATTERN
from tallywire.sources import binary, files, resync


def test_frames_there_and_back(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, [rng.randrange(4096) for _ in range(128)]) for k in range(5)]
    df = spark.createDataFrame(rows, "k long, adcs array<int>")
    made = binary.create_frames(df, source=F.lit(0x123), tick=1000 + 25 * F.col("k"), number=F.col("k"))
    words = {r.k: r.words for r in made.collect()}
    raw = b"".join(struct.pack("<30Q", *(w & (1 << 64) - 1 for w in words[k])) for k in range(5))
    binary.write_frames(made.coalesce(1).sortWithinPartitions("k"), str(tmp_path / "out"))
    names = [n for n in os.listdir(tmp_path / "out") if n.endswith(".bin")]
    assert [(tmp_path / "out" / n).read_bytes() for n in names] == [raw] and len(os.listdir(tmp_path / "out")) == 1
    (tmp_path / "frames.bin").write_bytes(raw + b"rest")
    for place in ("out", "frames.bin"):
        read = binary.read_frames(spark, str(tmp_path / place), split=500)
        assert read.rdd.getNumPartitions() == 3  # two frames each
        assert {r.k: r.words for r in read.collect()} == words
    for r in binary.decode_frames(read).collect():
        assert (r.comma, r.version, r.id, r.errors, r.tick) == (0xBC, 1, 0x123, 0, 1000 + 25 * r.k)
        assert r.streams[0].adcs + r.streams[1].adcs == rows[r.k][1] and r.streams[1].convert == 0x100 + r.k


def test_one_large_file_is_many_tasks(spark, tmp_path):
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(1 << 30)  # a gigabyte of holes
    read = binary.read_frames(spark, f"file://{tmp_path}/large.bin")
    parts = [p for p in files.FixedRecords({"path": str(tmp_path / "large.bin"), "word": "i64", "words": "30"}).reader(read.schema).partitions()]
    assert read.rdd.getNumPartitions() == len(parts) == 17
    assert sum(p.length for p in parts) == (1 << 30) // 240 * 240 and all(p.offset % 240 == 0 for p in parts)
    assert resync.blocks_of(spark, str(tmp_path / "large.bin")).count() == 1024


def test_odd_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    assert binary.read_frames(spark, str(tmp_path / "d")).count() == 0
    (tmp_path / "d" / "empty.bin").write_bytes(b"")
    (tmp_path / "d" / "short.bin").write_bytes(b"x" * 239)
    (tmp_path / "d" / "_hidden").write_bytes(b"x" * 480)
    assert binary.read_frames(spark, str(tmp_path / "d")).count() == 0
    assert resync.read_slices(spark, str(tmp_path / "d" / "empty.bin")).count() == 0
    with pytest.raises(Exception, match="missing"):
        binary.read_frames(spark, str(tmp_path / "missing")).count()
    with pytest.raises(Exception, match="30 words"):
        binary.write_frames(spark.createDataFrame([([1, 2],)], "words array<long>"), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="does not fit"):
        binary.write_samples(spark.createDataFrame([([1, 70000],)], "adcs array<int>"), str(tmp_path / "worse"), samples=2, channels=1)


def test_sample_dump(spark, tmp_path):
    grid = np.arange(20 * 8 * 4, dtype="<u2").reshape(20, 8, 4)
    (tmp_path / "run.dat").write_bytes(grid.tobytes() + b"\0\0\0")
    want = {(p, c): grid[p, :, c].tolist() for p in range(20) for c in range(4)}
    for split in (100, 64 << 20):
        rows = binary.read_samples(spark, str(tmp_path / "run.dat"), samples=8, channels=4, split=split).collect()
        assert {(r.pkt, r.ch): r.adcs for r in rows} == want and len(rows) == 80
    packets = spark.createDataFrame([(p, grid[p].ravel().tolist()) for p in range(20)], "pkt long, adcs array<int>")
    binary.write_samples(packets.coalesce(1).sortWithinPartitions("pkt"), str(tmp_path / "again"), samples=8, channels=4)
    rows = binary.read_samples(spark, str(tmp_path / "again"), samples=8, channels=4).collect()
    assert {(r.pkt, r.ch): r.adcs for r in rows} == want


def test_records(spark, tmp_path):
    parts = [(0, b"data"), (1, b"<xml/>"), (0, b"")] + [(i % 16, bytes([i % 256]) * i) for i in range(700)]
    raw = b"".join(struct.pack("<I", len(p) | t << 28) + p for t, p in parts) + struct.pack("<I", 99) + b"cut"
    (tmp_path / "a.dat").write_bytes(raw)
    (tmp_path / "b.dat").write_bytes(b"")
    rows = sorted(binary.read_records(spark, str(tmp_path)).collect(), key=lambda r: r.n)
    assert [(r.type, bytes(r.payload)) for r in rows] == parts


def _sequential(raw):
    """What a reader of one file meets, byte after byte."""
    at, out = 0, []
    while at < len(raw):
        if at + 16 > len(raw):
            out.append((at, "cut", None))
            break
        size = struct.unpack_from("<I", raw, at)[0]
        if size > LARGEST_MESSAGE:
            out.append((at, "damaged", None))
            at += 16
            while at + 4 <= len(raw) and struct.unpack_from("<I", raw, at)[0] != TRAILER_PATTERN:
                at += 4
            if at + 4 > len(raw):
                break
            at += 4
        elif at + max(size, 16) > len(raw):
            out.append((at, "cut", None))
            break
        else:
            out.append((at, "record", raw[at : at + max(size, 16)]))
            at += max(size, 16)
    return out


def _slice(rng, n, size=None, trailer=True):
    body = rng.randbytes(4 * rng.randrange(0, n) + rng.choice([0, 0, 0, 1, 2, 3]))
    body += struct.pack("<I", TRAILER_PATTERN) if trailer else b""
    return struct.pack("<4I", len(body) + 16 if size is None else size, rng.randrange(1 << 32), 1, 2) + body


def test_damaged_streams(spark, tmp_path):
    """Against a sequential reader: damage, markers at odd places and over the ends of blocks, runs of zeros, cut ends."""
    rng, streams = random.Random(12), {}
    for i in range(12):
        raw = b""
        while len(raw) < 40_000:
            kind = rng.random()
            if kind < 0.15:
                raw += _slice(rng, 200, size=rng.choice([265_001, 0xFFFFFFFF, 0x20202020]), trailer=rng.random() < 0.6)
            elif kind < 0.2:
                raw += b"\0" * rng.randrange(400)
            elif kind < 0.25:
                raw += _slice(rng, 30, size=rng.choice([0, 3, 15]))
            elif kind < 0.3:
                raw += rng.randbytes(rng.randrange(300)) + struct.pack("<I", TRAILER_PATTERN)
            else:
                raw += _slice(rng, rng.choice([3, 100, 1500]))
        streams[f"s{i}.bin"] = raw[: len(raw) - rng.randrange(100)]
    streams |= {"marker.bin": struct.pack("<4I", 1 << 30, 0, 0, 0) + b"a" * 4096, "tiny.bin": b"abc", "header.bin": struct.pack("<4I", 16, 7, 8, 9)}
    for name, raw in streams.items():
        (tmp_path / name).write_bytes(raw)
    for block in (1000, 4096, 1 << 20):
        rows = resync.read_slices(spark, str(tmp_path), block=block).collect()
        for name, raw in streams.items():
            got = sorted((r.at, r.kind, None if r.data is None else bytes(r.data)) for r in rows if r.file.endswith(f"/{name}"))
            assert got == _sequential(raw), (name, block)
    header = next(r for r in rows if r.file.endswith("header.bin"))
    assert (header.size, header.sequence, header.second, header.type) == (16, 7, 8, 9)


def test_records_are_read_by_spans(spark, tmp_path, monkeypatch):
    """Files are read by spans of records, not opened for each record; whatever a span holds, every record comes once, as it is."""
    rng, held, keep = random.Random(4), [], binary.written
    monkeypatch.setattr(binary, "written", lambda df, name: held.append(keep(df, name)) or held[-1])
    want = []
    for f in range(2):
        data = b""
        for n in range(300):
            payload = rng.randbytes(rng.choice([0, 1, 50, 90_000 if n % 100 == 5 else 7]))
            want.append((f, n, len(data), n % 16, payload))
            data += struct.pack("<I", len(payload) | (n % 16) << 28) + payload
        (tmp_path / f"{f}.dat").write_bytes(data + struct.pack("<I", 100) + b"cut")
    for span in (1, 500, 1 << 20):
        got = binary.read_records(spark, str(tmp_path), span=span) if span < 1 << 20 else binary.read_records(spark, str(tmp_path))
        assert sorted((int(r.file[-5]), r.n, r.at, r.type, bytes(r.payload)) for r in got.collect()) == want
    assert held[-1].count() == 2
