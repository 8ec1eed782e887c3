import json
import random

import pytest
from pyspark.sql import functions as F

from tallywire.operators import frames as O
from tallywire.sources.folders import shared_root
from tallywire.sources.views import frames
from tallywire.streaming import counters as C
from tallywire.streaming import state as S


def _run(spark, result, root, mode="append"):
    """Runs a stream over what is there, and tells the state rows it is left with."""
    writer = result.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/data").option("checkpointLocation", f"{root}/checkpoint")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return [sum(op["numRowsTotal"] for op in json.loads(p.json)["stateOperators"]) for p in query.recentProgress]


def test_watermarked_rates(spark):
    rows = spark.range(0, 500).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit(2).alias("bytes"))
    root = shared_root(spark)
    rows.coalesce(1).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    C.run_available(C.windowed_rates(stream), f"{root}/run")
    got = spark.read.parquet(f"{root}/run/data").agg(F.min("records"), F.max("records"), F.count("*")).first()
    assert got[0] == got[1] == 60 and got[2] >= 5


def test_stream_join_around_triggers(spark):
    root = shared_root(spark)
    at = F.timestamp_seconds(F.col("id") * 10)
    spark.range(0, 60).select(F.lit(1).alias("src"), at.alias("at"), "id").coalesce(1).write.parquet(f"{root}/p")
    spark.range(10, 40, 10).select(F.lit(1).alias("trg_src"), at.alias("t0"), F.col("id").alias("trg")).coalesce(1).write.parquet(f"{root}/t")
    read = lambda n: spark.readStream.schema(spark.read.parquet(f"{root}/{n}").schema).parquet(f"{root}/{n}")
    C.run_available(C.triggered(read("p"), read("t"), before="20 seconds", after="20 seconds", late="1 minute"), f"{root}/run")
    got = sorted((r.trg, r.id) for r in spark.read.parquet(f"{root}/run/data").collect())
    assert got == [(t, t + d) for t in (10, 20, 30) for d in (-2, -1, 0, 1)]


def test_software_triggers(spark):
    root = shared_root(spark)
    made = C.software_triggers(spark, 20)
    query = made.writeStream.format("parquet").option("path", f"{root}/data").option("checkpointLocation", f"{root}/c").start()
    while query.lastProgress is None or not spark.read.schema(made.schema).parquet(f"{root}/data").count():
        assert query.isActive
    query.stop()
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{root}/data").collect())
    assert [n for n, _ in rows] == list(range(len(rows)))
    assert rows[-1][1] > rows[0][1] or len(rows) == 1


def test_fan_out(spark):
    seen = []
    C.fan_out([lambda b, n: seen.append(("a", n, b.count())), lambda b, n: seen.append(("b", n, b.count()))])(spark.range(3), 7)
    assert seen == [("a", 7, 3), ("b", 7, 3)]


class Feed:
    """A folder that is streamed, batch by batch, with a restart of the query before each."""

    def __init__(self, spark, schema, operator):
        self.spark, self.schema, self.operator, self.root = S.with_timers(spark), schema, operator, shared_root(spark)
        spark.createDataFrame([], schema).write.parquet(f"{self.root}/in")

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).repartition(2).write.mode("append").parquet(f"{self.root}/in")
        return _run(self.spark, self.operator(self.spark.readStream.schema(self.spark.read.parquet(f"{self.root}/in").schema).parquet(f"{self.root}/in")), self.root)

    def rows(self):
        return sorted((tuple(r) for r in self.spark.read.parquet(f"{self.root}/data").collect()), key=repr)


def test_packets_flush_and_forget(spark):
    """Full packets at once; a flush frame closes its key's packet; a key that is idle is flushed by its timer, and no state is left."""
    t = lambda s: __import__("datetime").datetime.fromtimestamp(1_700_000_000 + s)
    schema = "ch long, seq long, value long, flush boolean, at timestamp"
    feed = Feed(spark, schema, lambda s: S.packets_by_count(s, size=4, idle="60 seconds", late="10 seconds"))
    feed.add([(1, i, i, False, t(i)) for i in range(6)] + [(2, i, 1, False, t(i)) for i in range(3)] + [(None, 0, None, False, t(0))])
    assert feed.rows() == [(1, 0, 3, 4, 6, False)]
    feed.add([(1, i, i, False, t(i)) for i in range(4, 9)] + [(2, None, None, True, t(9)), (3, 7, 7, False, t(9)), (4, None, None, True, t(9))])
    # frames 4 and 5 came again and count once
    assert feed.rows() == [(1, 0, 3, 4, 6, False), (1, 4, 7, 4, 22, False), (2, 0, 2, 3, 3, True)]
    left = feed.add([(9, 1, 1, False, t(500))])
    assert [r for r in feed.rows() if r[0] != 9][-2:] == [(3, 7, 7, 1, 7, True), (None, 0, 0, 1, 0, True)] and (1, 8, 8, 1, 8, True) in feed.rows()
    last = feed.add([(9, None, None, True, t(501)), (None, None, None, True, t(5000))])
    assert (9, 1, 1, 1, 1, True) in feed.rows() and len(feed.rows()) == 7
    assert last[-1] < left[0]  # the state of all but the latest is gone
    assert last[-1] == 0, last


def test_stream_status_equals_batch(spark, sf):
    """Over restarts, with repeated frames, equal to the batch."""
    rows = frames(spark, sf).filter("k < 40").cache()
    want = sorted((r.link, r.k, r.status) for r in O.status(rows).collect())
    feed = Feed(spark, rows.schema, lambda s: S.stream_status(s).select("link", "k", "status"))
    every = [tuple(r) for r in rows.collect()]
    left = [feed.add([r for r in every if low <= r[1] < high]) for low, high in ((0, 15), (10, 16), (16, 40))]
    assert feed.rows() == sorted(want, key=repr)
    assert left[0][-1] == left[-1][-1]  # one row a link, whatever has passed


@pytest.mark.parametrize("late", [0, 30])
def test_gating_in_any_order(spark, late):
    rng = random.Random(5)
    t = lambda s: __import__("datetime").datetime.fromtimestamp(1_700_000_000 + s)
    rows = [(rng.choice([1, 2, None]), i, rng.randrange(10 * i, 10 * i + 1 + late), rng.choice([0, 0, 0, 1, 2])) for i in range(60)]
    schema = "ch long, id long, at timestamp, cmd int"
    feed = Feed(spark, schema, lambda s: S.gated(s.filter("cmd = 0"), s.filter("cmd <> 0"), late="40 seconds"))
    mixed = [rows[i : i + 20] for i in range(0, 60, 20)]
    for part in mixed:
        rng.shuffle(part)
        feed.add([(c, i, t(s), cmd) for c, i, s, cmd in part])
    feed.add([(7, 1000, t(5000), 0)])
    want, on = [], {}
    for c, i, s, cmd in sorted(rows, key=lambda r: (r[2], r[1])):
        on[c] = cmd == 1 or (on.get(c, False) and cmd != 2)
        want.append((c, i, t(s), cmd, on[c]))
    assert feed.rows() == sorted(want, key=repr)


def test_reconnect_and_restart(spark):
    """A gap within a connection is told, one over a new connection is not; rows that come twice count once."""
    feed = Feed(spark, "link long, epoch long, seq long", S.sequence_gaps)
    feed.add([(1, 0, s) for s in (5, 6, 9)] + [(2, 0, 1)])
    feed.add([(1, 0, 9), (1, 0, 10), (1, 1, 0), (1, 1, 3), (2, 0, 2)])
    feed.add([(1, 1, 4), (1, 2, 77)])
    want = [(1, 0, 5, 0), (1, 0, 6, 0), (1, 0, 9, 2), (1, 0, 10, 0), (1, 1, 0, 0), (1, 1, 3, 2), (1, 1, 4, 0), (1, 2, 77, 0), (2, 0, 1, 0), (2, 0, 2, 0)]
    assert feed.rows() == sorted(want, key=repr)


class Kept:
    """A value in state, with what it was asked for."""

    def __init__(self):
        self.value, self.asked = None, []

    def exists(self):
        self.asked.append("exists")
        return self.value is not None

    def get(self):
        self.asked.append("get")
        return self.value

    def update(self, value):
        self.asked.append("update")
        self.value = value


def _frame(columns, *rows):
    import pandas as pd

    return pd.DataFrame(rows, columns=columns)


def test_polls_read_and_write_state_once(monkeypatch):
    """A key's polls cost one read and one write of its state, and a long key's go out in frames of a bounded size."""
    monkeypatch.setattr(S, "FRAME_ROWS", 2)
    polls, seen = ["path", "us", "n", "value"], S._Poll("path", "value")
    seen.last = Kept()
    parts = [_frame(polls, (1, 20, 2, "b"), (1, 10, 1, "a"), (1, 20, 3, "b")), _frame(polls, (1, 15, 9, "c"), (1, 30, 4, None))]
    got = [[tuple(row) for row in frame.itertuples(index=False)] for frame in seen.handleInputRows((1,), iter(parts), None)]
    assert got == [[(1, 10, 1, "a", "new"), (1, 15, 9, "c", "changed")], [(1, 20, 2, "b", "changed"), (1, 30, 4, None, "gone")]]
    assert not list(seen.handleInputRows((1,), iter([_frame(polls, (1, 25, 5, "d"))]), None))  # older than the state
    assert seen.last.asked == ["get", "update"] * 2 and seen.last.value == (30, None)


def test_odd_polls(spark):
    """Null values, times and numbers, repeats and older polls, over restarts; a null path is a path."""
    t = lambda s: __import__("datetime").datetime.fromtimestamp(1_700_000_000 + s)
    feed = Feed(spark, "path long, at timestamp, n int, value string", lambda s: S.changes(s))
    feed.add([(1, t(2), 3, "b"), (1, t(1), 1, "a"), (1, t(1), 2, "a"), (1, t(2), 3, "b"), (2, None, 1, "a"), (3, t(1), 1, None)])
    want = [(1, t(1), 1, "a", "new"), (1, t(2), 3, "b", "changed"), (3, t(1), 1, None, "new")]
    assert feed.rows() == sorted(want, key=repr)
    feed.add([(1, t(1), 9, "late"), (1, t(2), 4, None), (1, t(3), 5, "b"), (3, t(2), 2, None), (3, t(3), 3, "a"), ((1 << 53) + 1, t(3), 1, "")])
    want += [(1, t(2), 4, None, "gone"), (1, t(3), 5, "b", "changed"), (3, t(3), 3, "a", "changed"), ((1 << 53) + 1, t(3), 1, "", "new")]
    assert feed.rows() == sorted(want, key=repr)
    for poll in [(None, t(1), 1, "x"), (None, t(2), None, "y"), (None, t(2), 7, "y")]:
        feed.add([poll])
    assert [r for r in feed.rows() if r[0] is None] == [(None, t(1), 1, "x", "new"), (None, t(2), 0, "y", "changed")]


class Listed(Kept):
    """A list in state."""

    def __init__(self):
        super().__init__()
        self.value = []

    def get(self):
        self.asked.append("get")
        return iter(self.value)

    def put(self, rows):
        self.asked.append("put")
        self.value = list(rows)

    def appendList(self, rows):  # noqa: N802
        self.asked.append("append")
        self.value += rows

    def clear(self):
        self.asked.append("clear")
        self.value = []


class Timers:
    """The timers of a key, and the time that a processor is given."""

    def __init__(self):
        self.at, self.now, self.asked = set(), 0, []

    def listTimers(self):  # noqa: N802
        return iter(sorted(self.at))

    def registerTimer(self, ms):  # noqa: N802
        self.asked.append("register")
        self.at.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.asked.append("delete")
        self.at.discard(ms)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now

    def expire(self, processor, key, now):
        """What Spark does at the end of a batch: the timers up to the watermark go off, and each is deleted behind its call."""
        self.now, found = now, []
        for ms in [t for t in sorted(self.at) if t <= now]:
            found += [tuple(row) for frame in processor.handleExpiredTimer(key, self, None) for row in frame.itertuples(index=False)]
            self.at.discard(ms)
        return found


def test_gate_puts_rows_by_without_reading_those_that_wait():
    """What waits is read when some of it is due, and is written again only then; the timer is moved only by an earlier row."""
    rows, gate, timers = ["ch", "id", "cmd", "at", "us"], S._Gate("ch"), Timers()
    gate.handle, gate.on, gate.waiting = timers, Kept(), Listed()
    put = lambda *some: list(gate.handleInputRows((1,), iter([_frame(rows, *((1, i, cmd, None, us) for i, cmd, us in some))]), timers))
    assert not put((1, 1, 5000), (2, 0, 7000)) and not put((3, 0, 9000)) and not put((4, 2, 4500))
    assert gate.waiting.asked == ["append"] * 3 and not gate.on.asked and timers.at == {5} and timers.asked == ["register", "delete", "register"]
    assert timers.expire(gate, (1,), 4) == []
    assert timers.expire(gate, (1,), 7) == [(1, 4, 4500, 2, False), (1, 1, 5000, 1, True)]
    assert timers.at == {8} and gate.waiting.value == [(7000, 2, 0), (9000, 3, 0)] and gate.on.value == (True,)
    assert not put((5, 0, 6500)) and timers.at == {7}  # due already: it goes out at the end of its batch
    assert timers.expire(gate, (1,), 7) == [(1, 5, 6500, 0, True)] and timers.at == {8}
    assert timers.expire(gate, (1,), 10) == [(1, 2, 7000, 0, True), (1, 3, 9000, 0, True)] and not timers.at and not gate.waiting.value
    assert gate.on.asked.count("update") == 1


def test_odd_gating(spark):
    """Null ids and commands, times that are null or the same, and rows that come twice; a null channel is a channel."""
    t = lambda s: __import__("datetime").datetime.fromtimestamp(1_700_000_000 + s)
    feed = Feed(spark, "ch long, id long, at timestamp, cmd int", lambda s: S.gated(s.filter("coalesce(cmd, 0) = 0"), s.filter("cmd <> 0"), late="5 seconds"))
    feed.add([(1, 1, t(1), 1), (1, None, t(1), 0), (1, 2, t(2), None), (1, 3, None, 1), (1, 4, t(3), 2), (1, 4, t(3), 2), (2, 5, t(2), 0), (2, 5, t(2), 0)])
    feed.add([(1, 6, t(4), 0), (2, 7, t(1), 1), (2, 8, t(1), 8)])
    feed.add([(None, 9, t(100), 1)])
    feed.add([(None, 10, t(101), 0)])
    feed.add([(7, 11, t(1000), 0)])
    want = [(1, -1, t(1), 0, False), (1, 1, t(1), 1, True), (1, 2, t(2), 0, True), (1, 4, t(3), 2, False), (1, 4, t(3), 2, False), (1, 6, t(4), 0, False)]
    want += [(2, 7, t(1), 1, True), (2, 8, t(1), 8, True), (2, 5, t(2), 0, True), (2, 5, t(2), 0, True), (None, 9, t(100), 1, True), (None, 10, t(101), 0, True)]
    assert feed.rows() == sorted(want, key=repr)


def test_packets_move_no_timer_with_every_batch():
    """State is read and written once a batch; the timer stays until it goes off, and is set again if frames came since. One that would be
    too late is moved."""
    frames, packets, timers = ["ch", "seq", "value", "flush", "at", "ms"], S._Packets("ch", 2, 100), Timers()
    packets.handle, packets.open = timers, Kept()
    packets.open.clear = lambda: setattr(packets.open, "value", None)

    def put(*some):
        made = packets.handleInputRows((1,), iter([_frame(frames, *((1, s, v, flush, None, ms) for s, v, flush, ms in some))]), timers)
        return [tuple(row) for frame in made for row in frame.itertuples(index=False)]

    assert put((2, 5, False, 20), (1, 4, False, 10), (3, 1, False, 30)) == [(1, 1, 2, 2, 9, False)]
    assert put((4, 1, False, 40), (5, 7, False, 50), (5, 7, False, 50)) == [(1, 3, 4, 2, 2, False)]
    assert packets.open.asked == ["get", "update"] * 2 and timers.asked == ["register"] and timers.at == {130}
    assert timers.expire(packets, (1,), 130) == [] and timers.at == {150}  # frame 5 came at 50
    assert put((6, 0, False, 45), (9, 0, True, 60), (9, 3, None, 60)) == [(1, 5, 6, 2, 7, False)] and timers.at == {150}  # a null flush is a frame, behind the others
    assert timers.expire(packets, (1,), 150) == [] and timers.at == {230}  # the watermark was 130 when they came
    assert put((10, 8, False, 300)) == [(1, 9, 10, 2, 11, False)] and timers.at == {230}
    assert put((11, 8, False, 20)) == [] and timers.at == {250} and packets.open.value[-1] == 250  # moved to what is earlier
    timers.now = 110
    assert put((11, 8, False, 20)) == [] and timers.at == {210}
    assert timers.expire(packets, (1,), 210) == [(1, 11, 11, 1, 8, True)] and not timers.at and packets.open.value is None
    assert put((1, 1, True, 900)) == [] and not timers.at and packets.open.value is None  # nothing to flush
