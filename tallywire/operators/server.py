"""Server commands as functions of tables: defaults, run states, reset counters, conversions in both directions.

A command is a row (at, command, argument); what it does to later rows is told by the last one before them. Values are texts, as a
device shows them.

Defined cases: without a command before it a row is as it was; a null argument is an empty one; a null value is
not converted; tables may be empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywire.operators.ranges import carried


@dataclass(frozen=True)
class Conversion:
    """How a raw value is shown, and how one that is shown is written."""

    shown: Callable[[Column], Column]
    written: Callable[[Column], Column]


def shown(variables: DataFrame, conversions: dict[str, Conversion], *, name: str = "name", value: str = "value") -> DataFrame:
    """Variables as they are shown: those that have a conversion through it, others as they are."""
    return _converted(variables, {n: c.shown for n, c in conversions.items()}, name, value)


def to_write(settings: DataFrame, conversions: dict[str, Conversion], *, name: str = "name", value: str = "value") -> DataFrame:
    """Settings as they are written to a device: the other direction."""
    return _converted(settings, {n: c.written for n, c in conversions.items()}, name, value)


def _converted(rows: DataFrame, conversions: dict[str, Callable[[Column], Column]], name: str, value: str) -> DataFrame:
    made = F.col(value)
    for n, convert in conversions.items():
        made = F.when((F.col(name) == n) & F.col(value).isNotNull(), convert(F.col(value))).otherwise(made)
    return rows.withColumn(value, made)


def set_defaults(variables: DataFrame, defaults: DataFrame, *, path: str = "path", value: str = "value", kind: str = "kind") -> DataFrame:
    """Configuration variables with their defaults (path, value); those without one, and status variables, keep their values."""
    given = defaults.groupBy(F.col(path).alias("_path")).agg(F.max(value).alias("_value"))
    met = variables.join(given, (variables[path] == given["_path"]) & (variables[kind] == "config"), "left")
    return met.select(*[F.coalesce("_value", variables[c]).alias(c) if c == value else variables[c] for c in variables.columns])


def run_states(rows: DataFrame, *, command: str = "command", argument: str = "argument", key: str = "key", order: tuple[str, ...] = ("at",), by: Column | None = None, initial: str = "Stopped") -> DataFrame:
    """Adds state: the argument of the key's last SetRunState up to the row; ``initial`` before the first."""
    said = F.when(F.col(command) == "SetRunState", F.coalesce(argument, F.lit("")))
    out = carried(rows, key=key, order=order, by=by, known={"_said": said})
    return out.withColumn("state", F.coalesce("_said.value", F.lit(initial))).drop("_said")


def since_reset(rows: DataFrame, *, command: str = "command", key: str = "key", order: tuple[str, ...] = ("at",), by: Column | None = None, size: Column | None = None) -> DataFrame:
    """Adds count: what has been counted (``size`` of each row, 1 by default) since the key's last ResetCount, the row of which counts
    nothing."""
    reset = F.col(command).eqNullSafe("ResetCount")
    one = F.when(reset, 0).otherwise(F.coalesce((F.lit(1) if size is None else size).cast("long"), F.lit(0)))
    # the sum up to a reset is known at its row: what is beyond it is the count since
    rows = carried(rows, key=key, order=order, by=by, sums={"_total": one})
    rows = carried(rows, key=key, order=order, by=by, known={"_reset": F.when(reset, F.col("_total"))})
    return rows.withColumn("count", F.col("_total") - F.coalesce("_reset.value", F.lit(0))).drop("_total", "_reset")
