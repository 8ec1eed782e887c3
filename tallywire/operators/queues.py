"""Bounded queues and admission: what a full queue drops, over keys of any length.

A queue of a given room gains at an arrival and loses at a service; it is never below empty or above full. Each such step is
``level -> clamp(level + add, low, high)``, and steps of this kind are closed under composition: a run of them is one triple (add, low,
high). So a range of rows is one small row, ranges are put together (by thousands, then those) on small rows alone, and within
a range the level at its begin is all that is needed. Rows are dealt out by key and range, and no task holds more of a key than a
range of rows, ``FAN`` ranges, or one row for each ``FAN`` ranges.

Defined cases: an empty table gives an empty one; a null key is a key; rows without an order come last in a range of their own,
before all others; a null service serves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.functions.scalars import floor_div
from tallywire.operators.ranges import by_number

#: Numbers of a sequence in a range, and ranges that are put together at a time.
RANGE, FAN = 1 << 14, 1 << 12


def _through(served: list, room: int, level: int) -> tuple[list[int], list[bool]]:
    """Levels after each arrival, and which were dropped, from a level at the begin."""
    levels, dropped = [], []
    for s in served:
        level = max(0, level - s)
        dropped.append(level == room)
        level = min(room, level + 1)
        levels.append(level)
    return levels, dropped


def _compose(steps: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Before each step, all steps before it as one; and all of them at the end."""
    add, low, high = 0, None, None  # nothing yet: no bounds
    out = []
    for a, lo, hi in steps:
        out.append((add, low, high))
        add += a
        low, high = (lo, hi) if low is None else (min(hi, max(lo, low + a)), min(hi, max(lo, high + a)))
    return [*out, (add, low, high)]


def _after(level: int, step: tuple) -> int:
    add, low, high = step
    return level if low is None else min(high, max(low, level + add))


def _summed(table, room: int):
    """A range as one step."""
    import pyarrow as pa

    table = table.sort_by([(c, "ascending") for c in table.column_names if c.startswith("_o")])
    total = _compose([(1 - s, 1, room) for s in table.column("_served").to_pylist()])[-1]
    return pa.table({"_key": table.column("_key")[:1], "_range": table.column("_range")[:1], **{n: pa.array([v], pa.int64()) for n, v in zip(("add", "low", "high"), total, strict=True)}})


def _grouped(table):
    """Ranges put together as one step."""
    import pyarrow as pa

    table = table.sort_by("_range")
    total = _compose(list(zip(*(table.column(c).to_pylist() for c in ("add", "low", "high")), strict=True)))[-1]
    return pa.table({"_key": table.column("_key")[:1], "_group": table.column("_group")[:1], **{n: pa.array([v], pa.int64()) for n, v in zip(("add", "low", "high"), total, strict=True)}})


def _begins(table, order: str):
    """The level at the begin of each step of a run, from ``_begin`` (the same in every row) or from an empty queue."""
    import pyarrow as pa

    table = table.sort_by(order)
    begin = (table.column("_begin")[0].as_py() or 0) if "_begin" in table.column_names else 0
    steps = _compose(list(zip(*(table.column(c).to_pylist() for c in ("add", "low", "high")), strict=True)))[:-1]
    return pa.table({"_key": table.column("_key"), order: table.column(order), "_begin": pa.array([_after(begin, s) for s in steps], pa.int64())})


def _leveled(table, room: int, keep: list[str]):
    table = table.sort_by([(c, "ascending") for c in table.column_names if c.startswith("_o")])
    levels, dropped = _through(table.column("_served").to_pylist(), room, table.column("_begin")[0].as_py() or 0)
    import pyarrow as pa

    return pa.table({**{c: table.column(c) for c in keep}, "level": pa.array(levels, pa.int64()), "dropped": pa.array(dropped, pa.bool_())})


def admit(rows: DataFrame, *, room: int, served: Column, key: str = "link", order: tuple[str, ...] = ("k",), by: Column | None = None) -> DataFrame:
    """Adds level and dropped: of a queue with ``room`` places, from which ``served`` records are taken before each arrival, the records in it
    after the arrival, and whether the arrival found it full. One that did is dropped and leaves the queue as it is.

    ``by`` is a whole number that never falls in the order, of which each range of rows has its own; by default the order's own
    numbers, by ``RANGE``."""
    if room < 1:
        raise ValueError("a queue has room for one record at least")
    columns, long = [c for c in rows.columns if c not in ("level", "dropped")], T.LongType()
    served = F.greatest(F.lit(0).cast("long"), F.coalesce(served.cast("long"), F.lit(0).cast("long")))
    ranges = F.coalesce((by_number(order[0], RANGE) if by is None else by).cast("long"), F.lit(-(1 << 62)))
    # the key's bytes stand for it among the small rows, so that a null one is a key too
    own = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    rows = rows.select(*columns, own.alias("_key"), ranges.alias("_range"), served.alias("_served"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    step = [T.StructField(n, long) for n in ("add", "low", "high")]
    of = lambda name, *more: T.StructType([T.StructField("_key", T.StringType()), T.StructField(name, long), *more])
    small = rows.select("_key", "_range", "_served", *[f"_o{i}" for i in range(len(order))])
    few = small.groupBy("_key", "_range").applyInArrow(lambda table: _summed(table, room), of("_range", *step))
    # ranges, even far apart, by their number: by thousands they are groups
    few = few.withColumn("_group", floor_div(F.col("_range"), FAN))
    groups = few.groupBy("_key", "_group").applyInArrow(_grouped, of("_group", *step))
    begins = groups.groupBy("_key").applyInArrow(lambda table: _begins(table, "_group"), of("_group", T.StructField("_begin", long)))
    inner = few.join(begins, ["_key", "_group"]).groupBy("_key", "_group").applyInArrow(lambda table: _begins(table, "_range"), of("_range", T.StructField("_begin", long)))
    met = rows.join(inner, ["_key", "_range"])
    made = T.StructType([*[rows.schema[c] for c in columns], T.StructField("level", long), T.StructField("dropped", T.BooleanType())])
    return met.groupBy("_key", "_range").applyInArrow(lambda table: _leveled(table, room, columns), made)
