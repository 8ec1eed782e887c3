"""Selection around triggers: interval joins, trimming, prescales, run gating."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.scalars import floor_div


#: Levels of buckets, and how much longer those of the next level are.
LEVELS, WIDER = 3, 64


def in_window(triggers: DataFrame, packets: DataFrame, before: int, length: int, *, keys: dict[str, str] | None = None, span: int | None = None) -> DataFrame:
    """Packets (beg, fin) that overlap a trigger's window [t0 - before, t0 - before + length), both half-open.

    A range join as an equal join: time is cut into buckets of ``span`` (the window's length, if not given), and again into buckets
    ``WIDER`` times as long for packets that are longer than so many buckets, on ``LEVELS`` levels. A packet enters the buckets it touches on
    its level, a trigger those on all levels; a pair is kept in the first bucket that both touch, so that it comes once.
    ``keys`` maps trigger columns to packet columns that must be equal besides.
    """
    span = span or max(1, length)
    size = lambda level: F.get(F.array(*[F.lit(span * WIDER**i).cast("long") for i in range(LEVELS)]), level)
    t = triggers.withColumn("win_beg", F.col("t0") - before).withColumn("win_fin", F.col("win_beg") + length)
    t = t.withColumn("_tl", F.explode(F.array(*[F.lit(i) for i in range(LEVELS)])))
    t = t.withColumn("_tb", F.explode(F.sequence(floor_div(F.col("win_beg"), size(F.col("_tl"))), floor_div(F.col("win_fin") - 1, size(F.col("_tl"))))))
    level = F.lit(LEVELS - 1)
    for i in range(LEVELS - 2, -1, -1):
        level = F.when(F.col("fin") - F.col("beg") <= span * WIDER ** (i + 1), i).otherwise(level)
    p = packets.withColumn("_pl", level)
    p = p.withColumn("_pb", F.explode(F.sequence(floor_div(F.col("beg"), size(F.col("_pl"))), floor_div(F.col("fin") - 1, size(F.col("_pl"))))))
    on = (F.col("_tl") == F.col("_pl")) & (F.col("_tb") == F.col("_pb")) & (F.col("beg") < F.col("win_fin")) & (F.col("fin") > F.col("win_beg"))
    on &= F.col("_tb") == F.greatest(floor_div(F.col("win_beg"), size(F.col("_tl"))), floor_div(F.col("beg"), size(F.col("_pl"))))
    for left, right in (keys or {}).items():
        on &= triggers[left] == packets[right]
    return t.join(p, on).drop("_tl", "_tb", "_pl", "_pb")


def trimmed(selected: DataFrame) -> DataFrame:
    """Adds from and upto: the part of each packet inside its window."""
    return selected.withColumn("from", F.greatest("beg", "win_beg")).withColumn("upto", F.least("fin", "win_fin"))


def prescaled(triggers: DataFrame, keep: int, of: int, *, key: str, order: tuple[str, ...] = ("t0", "trg_id")) -> DataFrame:
    """The first ``keep`` of every ``of`` triggers, counted for each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return triggers.withColumn("seq", F.row_number().over(w).cast("long") - 1).filter(F.col("seq") % of < keep)


def run_state(commands: DataFrame, *, key: str = "ch", order: tuple[str, ...] = ("ts", "event_id"), start: int = 1, stop: int = 2) -> DataFrame:
    """Adds running: the last start or stop so far was a start. Before any, nothing runs."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("cmd").isin(start, stop), F.col("cmd")), ignorenulls=True).over(w)
    return commands.withColumn("running", F.coalesce(last == start, F.lit(False)))


def event_numbers(commands: DataFrame, *, key: str = "ch", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Adds event: a number for each command, dropped ones too."""
    return commands.withColumn("event", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long") - 1)


def is_trigger(cmd):
    """Bit 3 of a command."""
    return F.shiftright(cmd, 3).bitwiseAND(1) == 1


def armed(commands: DataFrame, *, key: str = "ch", order: tuple[str, ...] = ("ts", "event_id"), arm: int = 1) -> DataFrame:
    """Triggers that fire: the first one after each arming command."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = commands.withColumn("arms", F.sum((F.col("cmd") == arm).cast("long")).over(w)).filter(is_trigger(F.col("cmd")) & (F.col("arms") > 0))
    rank = F.row_number().over(Window.partitionBy(key, "arms").orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def latched(commands: DataFrame, *, key: str = "ch", order: tuple[str, ...] = ("ts", "event_id"), clear: int = 2) -> DataFrame:
    """Adds latched: a trigger came since the last clearing command."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = commands.withColumn("_clears", F.sum((F.col("cmd") == clear).cast("long")).over(w))
    inner = Window.partitionBy(key, "_clears").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("latched", F.max(is_trigger(F.col("cmd"))).over(inner)).drop("_clears")


def pulses(commands: DataFrame, masks: DataFrame, delay: int, width: int, *, time: str = "t") -> DataFrame:
    """Delayed pulses of commands whose code is in a mask table (cmd): (…, rise, fall)."""
    return commands.join(masks, "cmd", "left_semi").withColumn("rise", F.col(time) + delay).withColumn("fall", F.col("rise") + width)


def fragments(selected: DataFrame, *, trigger: str = "trg_id", source: str = "src") -> DataFrame:
    """One nested record for each trigger: its streams, each with its packets and a table of contents; ``left`` counts the
    streams that follow."""
    streams = selected.groupBy(trigger, source).agg(
        F.sort_array(F.collect_list(F.struct("pkt", "from", "upto", "n"))).alias("packets"), F.sum("n").alias("bytes"), F.min("from").alias("beg"), F.max("upto").alias("fin")
    )
    streams = streams.withColumn("left", (F.count(F.lit(1)).over(Window.partitionBy(trigger)) - F.row_number().over(Window.partitionBy(trigger).orderBy(source))).cast("long"))
    return streams.groupBy(trigger).agg(F.sort_array(F.collect_list(F.struct(source, "left", "beg", "fin", "bytes", "packets"))).alias("streams"), F.sum("bytes").alias("bytes"))


def toc(parts: DataFrame, *, keys: tuple[str, ...], order: tuple[str, ...], size: str) -> DataFrame:
    """Adds offset: the sum of sizes before each part."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def files(records: DataFrame, most: int, *, order: tuple[str, ...], size: str, key: str) -> DataFrame:
    """Adds file: a new one begins with the record after that which takes a multiple of ``most`` bytes."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("file", floor_div(F.coalesce(F.sum(size).over(w), F.lit(0)), most))
