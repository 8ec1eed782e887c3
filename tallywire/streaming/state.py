"""Operators over streams that keep state by key, and let go of it.

Each is a processor of ``transformWithState``: state lies in a store by key, timers in event time close what will not go on.
Rows of a key come in any order within a batch and are put in order there; what a batch holds is bounded by its source
(``maxFilesPerTrigger`` and the like). A row behind what its key has already gone past is late, and is passed over.

These need the state store that keeps timers (:func:`with_timers` sets it).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tallywire.functions.bits import FRAME_HEADER, field
from tallywire.operators.frames import status_of

STORE = "spark.sql.streaming.stateStore.providerClass"
#: Rows of a key in a batch that are sorted as tuples, and of a frame that goes out, at most: what a long key adds is not held whole.
FRAME_ROWS = 10_000


def with_timers(spark: SparkSession) -> SparkSession:
    """The session, with the state store that these processors need."""
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _ordered(parts: Iterator, by: list[str]):
    """The rows of a key in a batch, in order."""
    import pandas as pd

    found = [part for part in parts if len(part)]
    return pd.concat(found, ignore_index=True).sort_values(by, kind="stable", ignore_index=True) if found else None


def _tuples(parts: Iterator, columns: list[str]) -> list[tuple]:
    """The rows of a key in a batch, as they came. Most keys have few: to join, sort and cast frames of so few rows costs more than the rows."""
    return [row for part in parts for row in zip(*(part[c] for c in columns), strict=True)]


def _in_order(parts: Iterator, columns: list[str]):
    """The rows of a key in a batch, in order of their first two columns, nulls last. Many rows are sorted as a frame, which takes less memory."""
    parts = list(parts)
    if sum(map(len, parts)) > FRAME_ROWS:
        found = _ordered(parts, columns[:2])
        return zip(*(found[c] for c in columns), strict=True)
    return sorted(_tuples(parts, columns), key=lambda row: (row[0], row[1] is None, row[1]))


def _frames(rows: Iterator, columns: list[str]) -> Iterator:
    """Rows in frames of a bounded size; no rows, no frame."""
    import pandas as pd

    while some := list(islice(rows, FRAME_ROWS)):
        yield pd.DataFrame(some, columns=columns)


class _Quiet(StatefulProcessor):
    """A processor without timers or anything to close."""

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        return iter(())

    def close(self) -> None:
        pass


# ---- the frame before, and the first one

CONTEXT = ("tick", "a0", "b0", "a1", "b1")


class _Context(_Quiet):
    """State by link: number and words of its last frame, and its first frame's id. Nothing grows."""

    def __init__(self, key: str, order: str, columns: list[str]) -> None:
        self.key, self.order, self.columns = key, order, columns

    def init(self, handle) -> None:
        words = ", ".join(f"{c} long" for c in CONTEXT)
        self.last = handle.getValueState("last", f"at long, first_id long, {words}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        frames = _ordered(rows, [self.order])
        before = self.last.get() if self.last.exists() else None
        if before is not None and frames is not None:
            frames = frames[frames[self.order] > before[0]].reset_index(drop=True)
        if frames is None or not len(frames):
            return
        first = before[1] if before is not None else int(frames["own_id"].iloc[0])
        for i, c in enumerate(CONTEXT):
            frames[f"prev_{c}"] = frames[c].astype("Int64").shift(1)
            if before is not None:
                frames.loc[0, f"prev_{c}"] = before[2 + i]
        frames["first_id"] = first
        end = frames.iloc[-1]
        self.last.update((int(end[self.order]), first, *(int(end[c]) for c in CONTEXT)))
        yield frames[[*self.columns, *(f"prev_{c}" for c in CONTEXT), "first_id"]]


def stream_status(frames: DataFrame, *, key: str = "link", order: str = "k", first_mask: str = "as_written") -> DataFrame:
    """A stream of frames with their status: the context (last frame, first id) is state, the checks are those of a batch.

    Defined cases: frames of a link come in order from batch to batch; one behind the link's last is late and passed over, so a repeated
    batch adds nothing; a null link is a link."""
    rows = frames.select("*", field(F.col("w0"), *FRAME_HEADER["id"]).alias("own_id"))
    long = T.LongType()
    fields = list(frames.schema.fields) + [T.StructField(f"prev_{c}", long) for c in CONTEXT] + [T.StructField("first_id", long)]
    made = rows.groupBy(key).transformWithStateInPandas(_Context(key, order, frames.columns), T.StructType(fields), "append", "none")
    prev = F.when(F.col("prev_tick").isNotNull(), F.struct(*[F.col(f"prev_{c}").alias(c) for c in CONTEXT]))
    return status_of(made.select(*frames.columns, prev.alias("prev"), "first_id"), first_mask=first_mask).select(*frames.columns, "status")


# ---- packets of a number of frames, flushed when no more come


class _Packets(StatefulProcessor):
    """State by key: first and last place, frames and sum of the open packet, which may have none yet, and the time behind the last
    frame at which the packet is flushed and the state dropped. A key has one timer, at that time or before it: one that goes off early
    is set again, rather than moved with every batch."""

    def __init__(self, key: str, size: int, idle_ms: int) -> None:
        self.size, self.idle, self.columns = size, idle_ms, [key, "first", "last", "n", "total", "flushed"]

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, n long, total long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        frames = _in_order(rows, ["seq", "flush", "value", "ms"])
        if frames:
            yield from _frames(self._packets(key, frames, timerValues.getCurrentWatermarkInMs()), self.columns)

    def _packets(self, key, frames, latest: int) -> Iterator[tuple]:
        first, last, n, total, timer = self.open.get() or (None, None, 0, 0, None)
        for seq, flush, value, ms in frames:
            if not flush:
                if last is not None and seq <= last:
                    continue  # late, or a repeat
                first, last, n, total = (int(seq), int(seq), 1, int(value)) if n == 0 else (first, int(seq), n + 1, total + int(value))
            latest = max(latest, int(ms))
            if n and (flush or n == self.size):
                yield key[0], first, last, n, total, n < self.size
                n = 0
        if last is not None:
            due = latest + self.idle
            if timer is None or due < timer:
                for old in list(self.handle.listTimers()) if timer is not None else ():
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(due)
            self.open.update((first, last, n, total, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        held = self.open.get()
        if held is None:
            return
        first, last, n, total, timer = held
        if timer > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(timer)  # frames came since this one was set
            return
        self.open.clear()
        if n:
            yield from _frames(iter([(key[0], first, last, n, total, True)]), self.columns)

    def close(self) -> None:
        pass


def packets_by_count(stream: DataFrame, *, size: int, idle: str = "1 hour", late: str = "1 hour", key: str = "ch") -> DataFrame:
    """Packets of exactly ``size`` frames of a stream (key, seq, value, flush, at): (key, first, last, n, total, flushed).

    A packet that is not full goes out, marked as flushed, at a flush frame (behind the frames up to its seq; a null one is behind all that came
    with it) or when its key has been idle in event time; the state of an idle key is dropped whole. Defined cases: frames behind the
    last one of their key are late and passed over, while the key has state; a flush without an open packet does nothing; a null
    value counts as 0."""
    seconds = stream.sparkSession.range(1).select(F.expr(f"cast(INTERVAL {idle} AS INTERVAL SECOND)").cast("long")).first()[0]
    seq, value = F.coalesce("seq", F.lit((1 << 63) - 1)).alias("seq"), F.coalesce(F.col("value").cast("long"), F.lit(0)).alias("value")
    rows = stream.withWatermark("at", late).select(key, seq, value, "flush", "at", F.unix_millis("at").alias("ms"))
    schema = T.StructType([T.StructField(key, stream.schema[key].dataType)] + [T.StructField(c, T.LongType()) for c in ("first", "last", "n", "total")] + [T.StructField("flushed", T.BooleanType())])
    return rows.groupBy(key).transformWithStateInPandas(_Packets(key, size, seconds * 1000), schema, "append", "eventTime")


# ---- run gating by a control stream


class _Gate(StatefulProcessor):
    """State by key: whether its run is on, and rows that wait until the watermark has passed them."""

    def __init__(self, key: str) -> None:
        self.key = key

    def init(self, handle) -> None:
        self.handle = handle
        self.on = handle.getValueState("on", "on boolean")
        self.waiting = handle.getListState("waiting", "us long, id long, cmd int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        """Rows are only put by: the timer at the first of them releases those that are due, in this batch if they are so already."""
        new = _tuples(rows, ["us", "id", "cmd"])
        self.waiting.appendList(new)
        due, timers = min(new)[0] // 1000 + 1, list(self.handle.listTimers())
        if not timers or due < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        """Rows before the watermark go in order; the rest waits, with a timer at its first. The timer that went off is Spark's to delete."""
        rows = sorted(self.waiting.get(), key=itemgetter(0, 1))
        n = bisect_left(rows, timerValues.getCurrentWatermarkInMs() * 1000, key=itemgetter(0))
        left = rows[n:]
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if n:
            yield from _frames(self._gated(key, islice(rows, n)), [self.key, "id", "us", "cmd", "running"])

    def _gated(self, key, rows: Iterator) -> Iterator[tuple]:
        said = self.on.get()
        on = said is not None and bool(said[0])
        for us, number, cmd in rows:
            on = cmd == 1 or (on and cmd != 2)
            yield key[0], number, us, cmd, on
        if said is None or on != said[0]:
            self.on.update((on,))

    def close(self) -> None:
        pass


def gated(data: DataFrame, control: DataFrame, *, late: str, key: str = "ch") -> DataFrame:
    """Data (key, id, at) and commands (key, id, at, cmd) of two streams in one: (key, id, at, cmd, running), each with the state of the run as
    of its time; commands 1 and 2 start and stop it, with their own row. Data may carry commands of another kind.

    A row waits in state until the watermark has passed it, as a command before it may still come; rows come in any order of files within
    ``late``. Rows of one time go by id; rows without a time are left out, as they
    are never due; a null id is -1, a null command is data."""
    own = F.col("cmd") if "cmd" in data.columns else F.lit(0).alias("cmd")
    both = data.select(key, "id", "at", own).unionByName(control.select(key, "id", "at", "cmd")).withWatermark("at", late)
    # no filter but on the time: it would go below the watermark, which rows of any kind move on
    both = both.filter("at IS NOT NULL").select(key, F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("cmd", F.lit(0)).alias("cmd"), "at", F.unix_micros("at").alias("us"))
    fields = [(key, data.schema[key].dataType), ("id", T.LongType()), ("us", T.LongType()), ("cmd", T.IntegerType()), ("running", T.BooleanType())]
    made = both.groupBy(key).transformWithStateInPandas(_Gate(key), T.StructType([T.StructField(n, t) for n, t in fields]), "append", "eventTime")
    return made.select(key, "id", F.timestamp_micros("us").alias("at"), "cmd", "running")


# ---- sequences over reconnects


class _Sequence(_Quiet):
    """State by key: the connection's number and the sequence it is expected to go on with."""

    def __init__(self, key: str) -> None:
        self.key = key

    def init(self, handle) -> None:
        self.next = handle.getValueState("next", "epoch long, expected long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        found = _ordered(rows, ["epoch", "seq"])
        epoch, expected = self.next.get() if self.next.exists() else (None, None)
        out = []
        for e, s in zip(found["epoch"] if found is not None else (), found["seq"] if found is not None else (), strict=True):
            e, s = int(e), int(s)
            if epoch is not None and (e, s) < (epoch, expected):
                continue  # late, or a repeat
            # a new connection voids what was expected
            out.append((key[0], e, s, s - expected if e == epoch else 0))
            epoch, expected = e, s + 1
        if out:
            self.next.update((epoch, expected))
            yield pd.DataFrame(out, columns=[self.key, "epoch", "seq", "missing"])


def sequence_gaps(stream: DataFrame, *, key: str = "link") -> DataFrame:
    """Records (key, epoch, seq) with the number missing before each: (key, epoch, seq, missing). ``epoch`` counts the connections of a key: the
    first record of each is never behind a gap. Records behind the expected one are late or repeated and are passed over."""
    schema = T.StructType([T.StructField(key, stream.schema[key].dataType)] + [T.StructField(c, T.LongType()) for c in ("epoch", "seq", "missing")])
    return stream.select(key, "epoch", "seq").groupBy(key).transformWithStateInPandas(_Sequence(key), schema, "append", "none")


# ---- polls


class _Poll(_Quiet):
    """State by path: the last value, whether it was there, and its time."""

    def __init__(self, key: str, value: str) -> None:
        self.key, self.value = key, value

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "us long, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        polls = _in_order(rows, ["us", "n", self.value])
        if polls:
            yield from _frames(self._changed(key, polls), [self.key, "us", "n", self.value, "kind"])

    def _changed(self, key, polls) -> Iterator[tuple]:
        at, before = self.last.get() or (None, None)
        for us, n, value in polls:
            value = None if value != value else value
            if at is not None and us < at:
                continue  # an older poll
            if at is None or value != before:
                yield key[0], us, n, value, "new" if at is None else "gone" if value is None else "changed"
            at, before = us, value
        self.last.update((at, before))


def changes(polls: DataFrame, *, key: str = "path", at: str = "at", order: str = "n", value: str = "value") -> DataFrame:
    """Polls (key, at, order, value) of a tree's leaves: only the leaves that are new, changed or gone (null), with their kind. The compact form of
    a status; the full one is every poll as it came."""
    rows = polls.filter(F.col(at).isNotNull()).select(key, F.unix_micros(at).alias("us"), F.coalesce(F.col(order).cast("long"), F.lit(0)).alias("n"), F.col(value).cast("string").alias(value))
    fields = [(key, polls.schema[key].dataType), ("us", T.LongType()), ("n", T.LongType()), (value, T.StringType()), ("kind", T.StringType())]
    made = rows.groupBy(key).transformWithStateInPandas(_Poll(key, value), T.StructType([T.StructField(n, t) for n, t in fields]), "append", "none")
    return made.select(key, F.timestamp_micros("us").alias(at), F.col("n").alias(order), value, "kind")
