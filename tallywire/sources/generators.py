"""Generated data: patterns, emulated pulses and noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywire.functions.scalars import floor_div
from tallywire.schema import CHANNELS, FRAME_WORDS, PEDESTAL, PULSE_BIPOLAR, PULSE_MONO, SAMPLES_PER_PACKET


def dummy_pattern(spark: SparkSession, samples: int = SAMPLES_PER_PACKET, words: int = FRAME_WORDS) -> DataFrame:
    """(i, j, bytes): word j of frame i, whose byte k is (i + k + 8j) mod 256, as hexadecimal digits, lowest byte first."""
    rows = spark.range(samples * words).select(floor_div(F.col("id"), words).alias("i"), (F.col("id") % words).alias("j"))
    byte = lambda k: F.lpad(F.lower(F.hex((F.col("i") + k + 8 * F.col("j")).bitwiseAND(F.lit(255).cast("long")))), 2, "0")
    return rows.select("i", "j", F.concat(*[byte(k) for k in range(8)]).alias("bytes"))


def emulator_pulses(spark: SparkSession, samples: int, every: int, channels: int = CHANNELS) -> DataFrame:
    """(ch, sample, adc): every third channel has the one-sided pulse, others the two-sided one; the pedestal between."""
    pulse = F.broadcast(spark.createDataFrame(list(zip(range(len(PULSE_MONO)), PULSE_MONO, PULSE_BIPOLAR, strict=True)), "step long, mono long, bipolar long"))
    rows = spark.range(channels * samples).select((F.col("id") % channels).alias("ch"), floor_div(F.col("id"), channels).alias("sample"))
    adc = F.coalesce(F.when(F.col("ch") % 3 == 2, F.col("mono")).otherwise(F.col("bipolar")), F.lit(PEDESTAL).cast("long"))
    return rows.join(pulse, F.col("sample") % every == F.col("step"), "left").select("ch", "sample", adc.alias("adc"))


def lfsr_step(state: Column, taps: tuple[int, ...] = (31, 6, 2, 1)) -> Column:
    """One shift of a 32-bit register: the parity of the tapped bits comes in at the low end."""
    bits = [F.shiftrightunsigned(state, t).bitwiseAND(F.lit(1).cast("long")) for t in taps]
    parity = bits[0]
    for b in bits[1:]:
        parity = parity.bitwiseXOR(b)
    return F.shiftleft(state, 1).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).bitwiseOR(parity)


def noise(spark: SparkSession, channels: int, samples: int, bits: int = 4, seed: int = 0xAE64B770) -> DataFrame:
    """(ch, noise array<long>): pseudo-random noise of a shift register for each channel, 32 shifts a sample."""

    def word(state: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(32)), state, lambda s, _: lfsr_step(s))

    first = F.pmod(F.col("id") * 2654435761 + seed, F.lit(0xFFFFFFFF)) + 1
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.lit(samples)),
        F.struct(first.cast("long").alias("state"), F.array().cast("array<bigint>").alias("out")),
        lambda s, _: F.get(F.transform(F.array(word(s["state"])), lambda n: F.struct(n.alias("state"), F.array_append(s["out"], n.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))).alias("out"))), F.lit(0)),
    )
    return spark.range(channels).select(F.col("id").alias("ch"), drawn["out"].alias("noise"))


def frame_rows(spark: SparkSession, n: int, *, run_enable: bool = True, flush: bool = False, empty: bool = False) -> DataFrame:
    """Frames of one flag setting: (k, adc0, sof, run_enable, flush, words): disabled and flush frames mark their channel
    in 0xf00; empty ones have no words."""
    words = 0 if empty else FRAME_WORDS
    return spark.range(n).select(
        F.col("id").alias("k"), F.lit(0xF00).alias("adc0"), F.lit(not empty).alias("sof"), F.lit(run_enable).alias("run_enable"), F.lit(flush).alias("flush"), F.lit(words).alias("words")
    )
