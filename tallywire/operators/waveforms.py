"""Delta coding of channels, symbol histograms, and what they say about size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.bits import bit_length, compose, field, unzigzag, zigzag
from tallywire.functions.scalars import floor_div
from tallywire.schema import HISTOGRAM_BINS


def deltas(samples: DataFrame, keys: tuple[str, ...] = ("ch", "pkt"), order: str = "seq", value: str = "adc") -> DataFrame:
    """Adds delta: the difference to the sample before, null for the first sample of each packet (its seed)."""
    return samples.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def symbols(samples: DataFrame, keys: tuple[str, ...] = ("ch", "pkt"), order: str = "seq", value: str = "adc") -> DataFrame:
    """Adds delta and sym; seeds have no symbol and are left out."""
    return deltas(samples, keys, order, value).filter(F.col("delta").isNotNull()).withColumn("sym", zigzag(F.col("delta")))


def bin_of(sym: Column) -> Column:
    """A symbol's bin: 0 gathers those that have none of their own."""
    return F.when(sym >= HISTOGRAM_BINS, 0).otherwise(sym).cast("long")


def histogram(syms: DataFrame, keys: tuple[str, ...] = ("ch", "pkt")) -> DataFrame:
    """(keys, bin, n)."""
    return syms.groupBy(*keys, bin_of(F.col("sym")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def overflow(syms: DataFrame, keys: tuple[str, ...] = ("ch", "pkt")) -> DataFrame:
    """(keys, over, over_min, over_max, over_bits) of symbols without a bin; packets that have any."""
    excess = F.col("sym") - HISTOGRAM_BINS
    out = syms.filter(excess >= 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("over"), F.min(excess).cast("long").alias("over_min"), F.max(excess).cast("long").alias("over_max"))
    return out.withColumn("over_bits", bit_length(F.col("over_max")).cast("long"))


def histogram_summary(bins: DataFrame, keys: tuple[str, ...] = ("ch", "pkt")) -> DataFrame:
    """Occupancy mask, largest count, and the last bins with at least one, two and four entries (-1: none)."""
    last = lambda k: F.coalesce(F.max(F.when(F.col("n") >= k, F.col("bin"))), F.lit(-1)).cast("long")
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bin").cast("int")))
    return bins.groupBy(*keys).agg(mask.alias("mask"), F.max("n").alias("max_count"), last(1).alias("last_gt0"), last(2).alias("last_gt1"), last(4).alias("last_gt3"))


def cumulative(bins: DataFrame, keys: tuple[str, ...] = ("ch", "pkt")) -> DataFrame:
    """Adds below: entries in lower bins, as a coder's table has them."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return bins.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long"))


def entropy_bits(bins: DataFrame, keys: tuple[str, ...] = ("ch", "pkt")) -> DataFrame:
    """Bits that an ideal coder needs for each packet: sum of n * log2(total / n)."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    return bins.withColumn("total", total).groupBy(*keys).agg(F.round(F.sum(F.col("n") * F.log2(F.col("total") / F.col("n"))), 6).alias("bits"), F.max("total").alias("symbols"))


def size_estimate(bins: DataFrame, keys: tuple[str, ...] = ("ch", "pkt"), full: int = 1024) -> DataFrame:
    """A writer's estimate of a packet's size, as if it held ``full`` symbols: bits, the sum of n * log2(full / n), and the 32-bit words
    to set aside, one more than the bits fill."""
    bits = F.round(F.sum(F.col("n") * F.log2(F.lit(float(full)) / F.col("n"))), 6)
    out = bins.groupBy(*keys).agg(bits.alias("bits"))
    return out.withColumn("words", floor_div(F.floor("bits"), 32) + 1)


def header_bits(bins: DataFrame, keys: tuple[str, ...] = ("ch", "pkt"), most: int = 1023) -> DataFrame:
    """Bits of a packet's coded histogram: 32, and for each bin up to the last the least of the bits of what is left
    and of the largest count."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    left = most - F.coalesce(F.sum("n").over(w), F.lit(0))
    widest = bit_length(F.max("n").over(Window.partitionBy(*keys)))
    return bins.withColumn("bits", F.least(bit_length(left), widest)).groupBy(*keys).agg((F.sum("bits") + 32).cast("long").alias("header_bits"))


def histogram_header(bins: DataFrame, firsts: DataFrame, keys: tuple[str, ...] = ("ch", "pkt"), *, most: int = 1023, size: int = HISTOGRAM_BINS) -> DataFrame:
    """(keys, header): the bits of each packet's coded histogram, as text. 32 bits tell format 0, bins less 1, bits of the largest count, the
    first sample and the bits of the largest overflow symbol; then each of ``size`` counts in as few bits as what is left and the
    largest count allow. ``bins`` (keys, bin, n); ``firsts`` (keys, first, over_bits)."""
    listed = bins.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"), F.max("n").alias("largest"))
    rows = listed.join(firsts, list(keys))
    width = bit_length(F.col("largest")).cast("long")
    prefix = compose(f=(F.lit(0), 28), b=(F.lit(size - 1), 20), m=(width, 16), a=(field(F.col("first"), 0, 12), 4), o=(F.col("over_bits"), 0))
    digits = lambda x, n: F.when(n > 0, F.lpad(F.bin(x), n.cast("int"), "0")).otherwise("")
    start = F.struct(F.lit(most).cast("long").alias("left"), digits(prefix, F.lit(32)).alias("text"))

    def told(state: Column, b: Column) -> Column:
        n = F.coalesce(F.try_element_at("counts", b), F.lit(0).cast("long"))
        bits = F.least(bit_length(state["left"]).cast("long"), width)
        return F.struct((state["left"] - n).alias("left"), F.concat(state["text"], digits(n, bits)).alias("text"))

    header = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")), start, told)
    return rows.select(*keys, header["text"].alias("header"))


def reconstruct(syms: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = ("ch", "pkt"), order: str = "seq") -> DataFrame:
    """Samples from seeds (keys, order, adc) and symbols (keys, order, sym): (keys, order, adc)."""
    steps = seeds.select(*keys, order, F.col("adc").alias("step")).unionByName(syms.select(*keys, order, unzigzag(F.col("sym")).cast("long").alias("step")))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*keys, order, F.sum("step").over(w).alias("adc"))


def transpose(samples: DataFrame, keys: tuple[str, ...] = ("ch", "pkt"), order: str = "seq", value: str = "adc") -> DataFrame:
    """Time-major rows to channel-major arrays: (keys, adcs)."""
    pairs = F.sort_array(F.collect_list(F.struct(order, value)))
    return samples.groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias("adcs"))


def decimate(samples: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """Every n-th sample."""
    return samples.filter(F.col(order) % n == 0)


def decimate_average(samples: DataFrame, n: int, key: str = "ch", order: str = "seq", value: str = "adc") -> DataFrame:
    """Whole-number means over n samples, of full groups only: (key, grp, mean)."""
    group = floor_div(F.col(order), n).alias("grp")
    return samples.groupBy(key, group).agg(floor_div(F.sum(value), n).alias("mean"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == n).drop("n")


def running_extremes(samples: DataFrame, key: str = "ch", order: str = "seq", value: str = "adc") -> DataFrame:
    """Adds low and high since the first sample."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("low", F.min(value).over(w)).withColumn("high", F.max(value).over(w))


def bit_counts(samples: DataFrame, value: str = "adc", bits: int = 12, keys: tuple[str, ...] = ("ch",)) -> DataFrame:
    """Samples in which each bit is set, and the bits that any has: (keys, bit, n)."""
    rows = samples.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"), value)
    set_ = F.call_function("shiftright", F.col(value), F.col("bit")).bitwiseAND(F.lit(1).cast("long"))
    return rows.groupBy(*keys, F.col("bit").cast("long").alias("bit")).agg(F.sum(set_).alias("n"))
