"""Counters, rates, health and matching of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywire.operators.ranges import previous


def rates(log: DataFrame, window: str, *, ts: str = "ts", size: str = "bytes", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, beg, records, bytes) by tumbling window."""
    return log.groupBy(*keys, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("records"), F.sum(size).alias("bytes")).select(*keys, F.col("w.start").alias("beg"), "records", "bytes")


def sliding_rates(log: DataFrame, window: str, slide: str, *, ts: str = "ts", size: str = "bytes") -> DataFrame:
    out = log.groupBy(F.window(ts, window, slide).alias("w")).agg(F.count(F.lit(1)).alias("records"), F.sum(size).alias("bytes"))
    return out.select(F.col("w.start").alias("beg"), "records", "bytes")


def clamped_steps(counts: DataFrame, *, key: str, order: str, value: str) -> DataFrame:
    """Adds step: growth of a counter, 0 where it went back."""
    rows = previous(counts, {"value": F.col(value)}, key=key, order=order)
    return rows.withColumn("step", F.greatest(F.col(value) - F.col("prev.value"), F.lit(0).cast("long"))).drop("prev")


def health(counts: DataFrame, *, key: str, order: str, errors: str) -> DataFrame:
    """Adds state: Error if the errors grew, else Warning if there are any, else Ready."""
    before = F.lag(errors).over(Window.partitionBy(key).orderBy(order))
    state = F.when(F.col(errors) > F.coalesce(before, F.lit(0)), "Error").when(F.col(errors) > 0, "Warning").otherwise("Ready")
    return counts.withColumn("state", state)


def changed(values: DataFrame, *, key: str, order: tuple[str, ...], value: str) -> DataFrame:
    """Rows whose value differs from the one before, and each key's first."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(value).over(w)
    return values.withColumn("_before", before).withColumn("_first", F.row_number().over(w) == 1).filter(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_first")


def matched(requests: DataFrame, responses: DataFrame, on: tuple[str, ...] = ("context", "address")) -> DataFrame:
    return requests.join(responses, list(on))


def unexpected(requests: DataFrame, responses: DataFrame, on: tuple[str, ...] = ("context", "address")) -> DataFrame:
    """Responses that no request asked for."""
    return responses.join(requests, list(on), "left_anti")


def timed_out(requests: DataFrame, responses: DataFrame, within: int, on: tuple[str, ...] = ("context", "address")) -> DataFrame:
    """Requests (t) without a response (rt) up to ``within`` later."""
    late = requests.join(responses, list(on), "left")
    ok = F.col("rt").isNotNull() & (F.col("rt") - F.col("t") <= within)
    return late.groupBy(*on, "t").agg(F.max(F.coalesce(ok, F.lit(False))).alias("_ok")).filter(~F.col("_ok")).drop("_ok")


def newest(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Replace by key: rows of ``updates``, and those of ``table`` whose key is not among them."""
    return table.join(updates, key, "left_anti").unionByName(updates)


def sessions(rows: DataFrame, gap: str, *, key: str, ts: str = "ts") -> DataFrame:
    """(key, beg, fin, n) of runs without a pause of ``gap``."""
    out = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("beg"), F.max(ts).alias("fin"))
    return out.select(key, "beg", "fin", "n")


def linked(values: DataFrame, links: list, *, name: str = "name", value: str = "value") -> DataFrame:
    """Rows of linked variables: each link (new name, name it is taken from, function of a column) gives one row for each row of
    that name. Functions work on columns, so that a user's conversion stays in the plan; a pandas UDF is one as well."""
    made = F.array(*[F.when(F.col(name) == source, F.struct(F.lit(new).alias("n"), convert(F.col(value)).cast("double").alias("v"))) for new, source, convert in links])
    rows = values.withColumn("_link", F.explode(F.filter(made, lambda x: x.isNotNull())))
    return rows.select(*[F.col("_link.n").alias(c) if c == name else F.col("_link.v").alias(c) if c == value else F.col(c) for c in values.columns])


def set_values(variables: DataFrame, settings: DataFrame, *, path: str = "path", value: str = "value", order: str = "n") -> DataFrame:
    """Variables with the values of a table of settings (path, order, value): the last one of a path counts, unknown paths are left
    out, and a setting of null is none."""
    last = settings.filter(F.col(value).isNotNull()).groupBy(F.col(path).alias("_path")).agg(F.max_by(value, F.struct(order, value)).alias("_value"))
    joined = variables.join(last, variables[path] == last["_path"], "left")
    return joined.select(*[F.coalesce("_value", variables[c]).alias(c) if c == value else variables[c] for c in variables.columns])
