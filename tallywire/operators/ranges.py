"""Running values over keys that are few and long: dealt out by ranges of the order, so that a key is many tasks.

A range is a monotone function of the order: a number of the sequence divided, a time cut to hours. One aggregate makes a small
row for each (key, range): its first and last row, its sums. What goes on from one range to the next is found on these
small rows alone. The rows themselves are dealt out once, by key and range, windowed within their range, and meet the small
rows by an equal join on the same two columns, which moves none of them again. Everything that a key's rows need is asked for
at once (``carried``): a second call would deal them out a second time.

Defined cases: an empty table gives an empty one; a null key is a key of its own; rows without an order come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.scalars import floor_div

#: Numbers of a sequence in a range.
RANGE = 1 << 16

Columns = dict[str, Column]


def by_number(order: str, size: int = RANGE) -> Column:
    """Ranges of a running number."""
    return floor_div(F.col(order), F.lit(size).cast("long"))


def _struct(columns: Columns) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def carried(
    rows: DataFrame, *, key: str = "link", order: tuple[str, ...] = ("k",), by: Column | None = None, previous: Columns | None = None, prev: str = "prev",
    first: Columns | None = None, sums: Columns | None = None, known: Columns | None = None,
) -> DataFrame:
    """Adds to each row, of its key's rows in order:

    * ``prev``: a struct of the columns ``previous`` of the row before, null for the first one,
    * the columns ``first`` of the first row,
    * ``sums``: sums of values up to and with the row,
    * ``known``: of each value the last one that is not null, up to and with the row, as a struct (value, at) with the first order
      column of its row.
    """
    columns, place = rows.columns, F.struct(*order)
    # within a struct, nulls are equal: the columns that rows are dealt out by are those that they are joined by
    within = F.struct((by_number(order[0]) if by is None else by).alias("range"))
    rows = rows.select("*", F.struct(F.col(key).alias("key")).alias("_key"), within.alias("_range"))
    inside = Window.partitionBy("_key", "_range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranges = Window.partitionBy("_of").orderBy("_at")
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    here, facts, over, out = [], [], [], []
    if previous:
        here.append(F.lag(_struct(previous)).over(inside).alias("_lag"))
        facts.append(F.max_by(_struct(previous), place).alias("_last"))
        over.append(F.lag("_last").over(ranges).alias("_before"))
        out.append(F.coalesce("_lag", "_before").alias(prev))
    if first:
        facts.append(F.min_by(_struct(first), place).alias("_head"))
        over.append(F.first("_head").over(ranges).alias("_first"))
        out += [F.col(f"_first.{n}").alias(n) for n in first]
    for n, value in (sums or {}).items():
        value = value.cast("long")
        here.append(F.sum(value).over(upto).alias(f"_in_{n}"))
        facts.append(F.sum(value).alias(f"_sum_{n}"))
        over.append(F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_to_{n}"))
        out.append((F.coalesce(F.col(f"_in_{n}"), F.lit(0)) + F.col(f"_to_{n}")).alias(n))
    for n, value in (known or {}).items():
        said = F.when(value.isNotNull(), F.struct(value.alias("value"), F.col(order[0]).alias("at")))
        here.append(F.last(said, True).over(upto).alias(f"_said_{n}"))
        facts.append(F.max_by(said, F.when(value.isNotNull(), place)).alias(f"_end_{n}"))
        over.append(F.last(f"_end_{n}", True).over(earlier).alias(f"_old_{n}"))
        out.append(F.coalesce(f"_said_{n}", f"_old_{n}").alias(n))
    few = rows.groupBy(F.col("_key").alias("_of"), F.col("_range").alias("_at")).agg(*facts).select("_of", "_at", *over)
    placed = rows.select("*", *here)
    met = placed.join(few, (placed["_key"] == few["_of"]) & (placed["_range"] == few["_at"]), "left")
    made = {prev if previous else None, *(first or {}), *(sums or {}), *(known or {})}
    return met.select(*[c for c in columns if c not in made], *out)


def previous(rows: DataFrame, columns: Columns, *, key: str = "link", order: str = "k", by: Column | None = None, out: str = "prev") -> DataFrame:
    """Adds ``out``: a struct of columns of the row before, null for a key's first row."""
    return carried(rows, key=key, order=(order,), by=by, previous=columns, prev=out)


def running_sum(rows: DataFrame, value: Column, *, out: str, key: str = "link", order: tuple[str, ...] = ("k",), by: Column | None = None) -> DataFrame:
    """Adds ``out``: the sum of a value up to and with each row."""
    return carried(rows, key=key, order=order, by=by, sums={out: value})


def numbered(rows: DataFrame, *, out: str, key: str = "link", order: tuple[str, ...] = ("k",), by: Column | None = None) -> DataFrame:
    """Adds ``out``: the running number of each row, from 0."""
    return running_sum(rows, F.lit(1), out=out, key=key, order=order, by=by).withColumn(out, F.col(out) - 1)


def first_of(rows: DataFrame, columns: Columns, *, key: str = "link", order: str = "k") -> DataFrame:
    """Adds columns of each key's first row."""
    return carried(rows, key=key, order=(order,), first=columns)
