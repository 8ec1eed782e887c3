"""Structured Streaming forms of the packet, window and state operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywire.functions.scalars import floor_div
from tallywire.sources.folders import shared_root


def packets_by_tick(stream: DataFrame, *, late: str, samples: int = 16, key: str = "ch", tick: str = "seq", value: str = "adc", at: str = "at") -> DataFrame:
    """Packets of a fixed number of ticks, of which there is one a second in ``at``: a packet is a window of time, and goes out when the
    watermark has passed it."""
    rows = stream.withWatermark(at, late).groupBy(key, F.window(at, f"{samples} seconds").alias("w"), floor_div(F.col(tick), samples).alias("pkt"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(key, "pkt", "n", "total")


def windowed_rates(stream: DataFrame, *, window: str = "1 hour", late: str = "2 hours", ts: str = "ts", size: str = "bytes") -> DataFrame:
    """Records and bytes by tumbling window, with a watermark for late ones."""
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("records"), F.sum(size).alias("bytes"))
    return out.select(F.col("w.start").alias("beg"), "records", "bytes")


def triggered(packets: DataFrame, triggers: DataFrame, *, before: str, after: str, late: str) -> DataFrame:
    """Packets (src, at) around triggers (trg_src, t0) of one source: an interval join of streams, whose watermarks bound how long
    packets are held."""
    p, t = packets.withWatermark("at", late), triggers.withWatermark("t0", late)
    return p.join(t, (p["src"] == t["trg_src"]) & (p["at"] >= t["t0"] - F.expr(f"INTERVAL {before}")) & (p["at"] < t["t0"] + F.expr(f"INTERVAL {after}")))


def software_triggers(spark: SparkSession, per_second: int) -> DataFrame:
    """Triggers at a fixed rate: (trg_id, t0)."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("value").alias("trg_id"), F.col("timestamp").alias("t0"))


def run_available(result: DataFrame, path: str, *, mode: str = "append", batch=None) -> None:
    """Run a stream over all that is there, then stop. The checkpoint lies beside the result, so a restart goes on."""
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    writer = writer.foreachBatch(batch) if batch else writer.format("parquet").option("path", f"{path}/data")
    writer.start().awaitTermination()


def source(spark: SparkSession, path: str, schema, *, files: int | None = None, size: str | None = None) -> DataFrame:
    """A stream of Parquet files with admission control: at most so many files, or so many bytes of them, in a batch; what is beyond waits in
    its folder."""
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return (reader.option("maxBytesPerTrigger", size) if size is not None else reader).parquet(path)


def listen(listeners: dict, *, kind: str = "kind"):
    """A batch function that calls each kind's listener with its rows, kinds in order of their names; ``None`` gets all rows. A listener that has
    no rows in a batch is not called."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        there = {r[0] for r in batch.select(kind).distinct().limit(len(listeners) + 64).collect()}
        for name in sorted(n for n in listeners if n is not None):
            if name in there:
                listeners[name](batch.filter(F.col(kind) == name), number)
        if None in listeners and there:
            listeners[None](batch, number)
        batch.unpersist()

    return each


def wait_for(stream: DataFrame, condition: Column, path: str, *, seconds: float, mode: str = "append") -> bool:
    """Runs a stream until a row meets a condition, or for so many seconds: whether one did."""
    import threading

    met = threading.Event()

    def look(batch: DataFrame, number: int) -> None:
        if not batch.filter(condition).isEmpty():
            met.set()

    query = stream.writeStream.outputMode(mode).foreachBatch(look).option("checkpointLocation", f"{path}/checkpoint").start()
    try:
        met.wait(seconds)
    finally:
        query.stop()
    return met.is_set()


def fan_out(sinks):
    """A batch function that gives each batch to several sinks; the batch is computed once."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, number)
        batch.unpersist()

    return each


def replay(tables: list[DataFrame], operator, *, order: str, slices: int = 2, tail: list[DataFrame] | None = None) -> DataFrame:
    """Stream tables through an operator in slices of time, and return all rows that it added.

    The tables are cut at the same times and written slice by slice; after each slice the query goes on from its checkpoint over
    what is there and stops, so that every slice begins with a restart. ``tail`` is a last slice, such as rows that push the watermark
    on."""
    spark = tables[0].sparkSession
    root = shared_root(spark)
    times = reduce(DataFrame.unionByName, [t.select(F.unix_micros(order).alias("t")) for t in tables])
    shares = [i / slices for i in range(1, slices)]
    cuts = (times.agg(F.percentile_approx("t", F.lit(shares))).first()[0] or []) if shares else []
    at = F.coalesce(F.unix_micros(order), F.lit(-(1 << 63)))  # rows without a time come first
    for i, t in enumerate(tables):
        t.limit(0).write.parquet(f"{root}/in{i}")  # the folders are there before the streams
    result = operator(*[spark.readStream.schema(t.schema).parquet(f"{root}/in{i}") for i, t in enumerate(tables)])
    edges = [-(1 << 63), *[c + 1 for c in cuts], (1 << 63) - 1]
    parts = [[t.filter((at >= low) & (at < high)) for t in tables] for low, high in zip(edges, edges[1:], strict=False)]
    for part in [*parts, *([tail] if tail else [])]:
        for i, rows in enumerate(part):
            rows.write.mode("append").parquet(f"{root}/in{i}")
        run_available(result, f"{root}/run")
    return spark.read.schema(result.schema).parquet(f"{root}/run/data")
