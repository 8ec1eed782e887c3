import datetime
import itertools
import random
import time

from pyspark.sql import functions as F

from tallywire.functions import bits as B
from tallywire.functions import scalars as S
from tallywire.operators import server as V
from tallywire.sources.decoders import decoded, decoders
from tallywire.sources.folders import shared_root
from tallywire.streaming import counters as C
from tallywire.streaming import state as T


def _tree(mask, bits):
    """Pairs of siblings of the tree over a mask, by recursion: (01, 10, 11)."""
    if bits == 1:
        return (0, 0, 0)
    half = bits // 2
    right, left = mask & ((1 << half) - 1), mask >> half
    own = ((right > 0) and not left, (left > 0) and not right, bool(right and left))
    return tuple(a + b + int(c) for a, b, c in zip(_tree(right, half), _tree(left, half), own, strict=True))


def _size(mask, bits=32):
    if mask == 0:
        return 0, bits
    n01, n10, n11 = _tree(mask, bits)
    sizes = [n01 + 2 * (n10 + n11), n10 + 2 * (n11 + n01), n11 + 2 * (n01 + n10)]
    best = (0, bits) if bits < sizes[0] else (1, sizes[0])
    for scheme in (2, 3):
        if sizes[scheme - 1] < best[1]:
            best = scheme, sizes[scheme - 1]
    return best


def test_tree_sizes(spark):
    rng = random.Random(1)
    masks = [*range(1 << 12), *[rng.getrandbits(32) for _ in range(2000)], *[rng.getrandbits(32) & rng.getrandbits(32) & rng.getrandbits(32) for _ in range(2000)], (1 << 32) - 1, 0x00011000]
    df = spark.createDataFrame([(m,) for m in masks], "m long").select("m", B.tree_size(F.col("m")).alias("s"))
    got = {r.m: tuple(r.s) for r in df.collect()}
    assert all(got[m] == _size(m) for m in masks)
    assert {s for s, _ in got.values()} == {0, 1, 2, 3}


def test_bit_units(spark):
    words = [0, 1, 5, 1 << 31, (1 << 32) - 1, 0x00F00000]
    df = spark.createDataFrame([(w,) for w in words], "w long")
    w = F.col("w")
    for r in df.select("w", B.count_ones(w).alias("n"), B.find_first(w).alias("f"), B.find_last(w).alias("l"), B.extract_left(w, 8, 8).alias("x")).collect():
        digits = f"{r.w:032b}"
        assert (r.n, r.f, r.x) == (digits.count("1"), digits.find("1") if r.w else 32, int(digits[8:16], 2))
        assert r.l == (digits[::-1].find("1") if r.w else 32)
    assert spark.range(1).select(B.count_ones(F.lit(-1).cast("long"))).first()[0] == 64


def test_paths(spark):
    df = spark.createDataFrame([("a", 1, "b"), ("a", None, "b")], "x string, i int, y string")
    made = df.select(S.path_of([(F.col("x"), F.col("i")), (F.col("y"), None)]).alias("p"))
    assert [r.p for r in made.collect()] == ["a(1):b", "a:b"]
    assert [[tuple(x) for x in r.q] for r in made.select(S.path_parts(F.col("p")).alias("q")).collect()] == [[("a", 1), ("b", None)], [("a", None), ("b", None)]]


def test_conversions_both_ways(spark):
    kelvin = V.Conversion(lambda v: F.format_string("%.2f K", v.cast("double") + 273.15), lambda v: F.round(F.split(v, " ")[0].cast("double") - 273.15, 2).cast("string"))
    df = spark.createDataFrame([("t", "20.0"), ("u", "20.0"), ("t", None)], "name string, value string")
    seen = V.shown(df, {"t": kelvin})
    assert [r.value for r in seen.collect()] == ["293.15 K", "20.0", None]
    assert [r.value for r in V.to_write(seen, {"t": kelvin}).collect()] == ["20.0", "20.0", None]


def test_commands_among_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, None]), i, rng.choice([None, None, None, "ResetCount", "SetRunState", "HardReset"]), rng.choice(["Enable", "Stopped", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, at long, command string, argument string")
    got = {r.at: r for r in V.since_reset(V.run_states(df, by=F.floor(F.col("at") / 7)), by=F.floor(F.col("at") / 11)).collect()}
    state, count = {}, {}
    for key, at, command, argument in rows:
        state[key] = (argument or "") if command == "SetRunState" else state.get(key, "Stopped")
        count[key] = 0 if command == "ResetCount" else count.get(key, 0) + 1
        assert (got[at].state, got[at]["count"]) == (state[key], count[key])
    assert V.since_reset(df.limit(0)).count() == 0


def test_defaults(spark):
    rows = spark.createDataFrame([("a", "config", "1"), ("b", "status", "2"), ("c", "config", None)], "path string, kind string, value string")
    given = spark.createDataFrame([("a", "9"), ("b", "9"), ("z", "9"), ("a", "8")], "path string, value string")
    assert {tuple(r) for r in V.set_defaults(rows, given).collect()} == {("a", "config", "9"), ("b", "status", "2"), ("c", "config", None)}


def test_two_decoders_in_one_query(spark):
    records = spark.createDataFrame([(1, 1, b"ab"), (2, 2, b"xyz"), (3, 7, b"?"), (4, 1, b""), (5, None, b"a"), (6, 1, None)], "n long, type int, payload binary")
    decode = decoders(spark, {1: lambda b: [("first", b[0]), ("last", b[-1])], 2: lambda b: [("size", len(b)), ("none", None)]}, name="decode_test")
    want = {(1, "first", "97"), (1, "last", "98"), (2, "size", "3"), (2, "none", None), (4, "error", "IndexError: index out of range")}
    assert {tuple(r) for r in decoded(records, decode, keep=["n"]).collect()} == want
    records.createOrReplaceTempView("test_records")
    sql = spark.sql("SELECT r.n, d.name, d.value FROM test_records r, LATERAL decode_test(r.type, r.payload) d")
    assert {tuple(r) for r in sql.collect()} == want


def test_polls_listeners_and_waiting(spark):
    T.with_timers(spark)
    root, start = shared_root(spark), datetime.datetime(2024, 1, 1)
    schema = "path string, at timestamp, n long, value string"
    polls = [{"a": "1", "b": "x"}, {"a": "1", "b": "y"}, {"a": "2", "b": "y", "c": None}, {"a": None, "b": "y", "c": "z"}, {"a": "3", "b": "y", "c": "z"}]
    heard = []
    on = lambda name: lambda batch, number: heard.append((name, sorted((r.path, r.value) for r in batch.collect())))
    listeners = {"new": on("new"), "changed": on("changed"), "gone": on("gone"), None: on("all")}
    spark.createDataFrame([], schema).write.parquet(f"{root}/in")
    for i, poll in enumerate(polls):
        rows = [(p, start + datetime.timedelta(seconds=i), 0, v) for p, v in poll.items()]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = T.changes(C.source(spark, f"{root}/in", schema, files=10))
        C.run_available(stream, f"{root}/run", batch=C.listen(listeners))
    # the difference of snapshots, and nothing for the leaves that stay
    want, last = [], {}
    for poll in polls:
        kinds = {k: sorted((p, v) for p, v in poll.items() if (p not in last or last[p] != v) and k == ("new" if p not in last else "gone" if v is None else "changed")) for k in ("changed", "gone", "new")}
        want += [(k, rows) for k, rows in kinds.items() if rows]
        if any(kinds.values()):
            want.append(("all", sorted(itertools.chain(*kinds.values()))))
        last |= poll
    assert heard == want
    stream = T.changes(C.source(spark, f"{root}/in", schema, files=1))
    assert C.wait_for(stream, F.col("value") == "z", f"{root}/wait", seconds=120)
    began = time.time()
    assert not C.wait_for(T.changes(C.source(spark, f"{root}/in", schema)), F.col("value") == "never", f"{root}/never", seconds=3)
    assert time.time() - began < 60
