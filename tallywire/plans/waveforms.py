"""Queries over channels of samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywire.functions.bits import count_ones, extract_left, find_first, find_last, tree_size
from tallywire.operators import waveforms as W
from tallywire.plans.register import query
from tallywire.schema import PEDESTAL, PULSE_BIPOLAR, PULSE_MONO
from tallywire.sources.generators import dummy_pattern as pattern
from tallywire.sources.generators import emulator_pulses
from tallywire.sources.views import SAMPLES, WAVES, samples, table, waves

DELTAS = f"{SAMPLES}, deltas AS (SELECT *, adc - lag(adc) OVER (PARTITION BY ch, pkt ORDER BY seq) AS delta FROM samples)"
SYMS = f"{DELTAS}, syms AS (SELECT *, CASE WHEN delta > 0 THEN 2 * delta ELSE -2 * delta + 1 END AS sym FROM deltas WHERE delta IS NOT NULL)"
HIST = f"{SYMS}, hist AS (SELECT ch, pkt, CAST(CASE WHEN sym >= 32 THEN 0 ELSE sym END AS BIGINT) AS bin, count(*) AS n FROM syms GROUP BY ALL)"
BITS = "CASE WHEN {0} > 0 THEN length(ltrim(bin({0}), '0')) ELSE 0 END"


def syms(spark, sf_dir):
    return W.symbols(samples(spark, sf_dir))


@query(f"WITH {HIST} SELECT ch, pkt, bin, n FROM hist")
def symbol_histogram(spark, sf_dir):
    return W.histogram(syms(spark, sf_dir))


@query(f"WITH {SYMS} SELECT ch, pkt, count(*) AS over, CAST(min(sym - 32) AS BIGINT) AS over_min, CAST(max(sym - 32) AS BIGINT) AS over_max, CAST({BITS.format('max(sym - 32)')} AS BIGINT) AS over_bits FROM syms WHERE sym >= 32 GROUP BY ch, pkt")
def symbol_overflow_stats(spark, sf_dir):
    return W.overflow(syms(spark, sf_dir))


@query(f"""WITH {HIST} SELECT ch, pkt, CAST(bit_or(CAST(1 AS BIGINT) << CAST(bin AS INTEGER)) AS BIGINT) AS mask, max(n) AS max_count,
    CAST(coalesce(max(bin) FILTER (n >= 1), -1) AS BIGINT) AS last_gt0, CAST(coalesce(max(bin) FILTER (n >= 2), -1) AS BIGINT) AS last_gt1,
    CAST(coalesce(max(bin) FILTER (n >= 4), -1) AS BIGINT) AS last_gt3 FROM hist GROUP BY ch, pkt""")
def hist_summary(spark, sf_dir):
    return W.histogram_summary(W.histogram(syms(spark, sf_dir)))


@query(f"WITH {HIST} SELECT ch, pkt, bin, n, CAST(coalesce(sum(n) OVER (PARTITION BY ch, pkt ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below FROM hist")
def hist_cumulative(spark, sf_dir):
    return W.cumulative(W.histogram(syms(spark, sf_dir)))


@query(f"WITH {HIST}, t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY ch, pkt) AS BIGINT) AS total FROM hist) SELECT ch, pkt, round(sum(n * log2(total / n)), 6) AS bits, max(total) AS symbols FROM t GROUP BY ch, pkt")
def hist_entropy_bits(spark, sf_dir):
    return W.entropy_bits(W.histogram(syms(spark, sf_dir)))


@query(f"""WITH {HIST}, t AS (SELECT ch, pkt, round(sum(n * log2(1024.0 / n)), 6) AS bits FROM hist GROUP BY ch, pkt) SELECT ch, pkt, bits, CAST(floor(bits) AS BIGINT) // 32 + 1 AS words FROM t""")
def hist_size_estimate(spark, sf_dir):
    """What a writer sets aside for each packet, as if it held 1024 symbols."""
    return W.size_estimate(W.histogram(syms(spark, sf_dir)))


@query(f"""WITH {HIST}, t AS (SELECT ch, pkt, 1023 - coalesce(sum(n) OVER (PARTITION BY ch, pkt ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    max(n) OVER (PARTITION BY ch, pkt) AS most FROM hist), u AS (SELECT ch, pkt, CAST(rest AS BIGINT) AS rest, most FROM t)
    SELECT ch, pkt, CAST(32 + sum(least({BITS.format('rest')}, {BITS.format('most')})) AS BIGINT) AS header_bits FROM u GROUP BY ch, pkt""")
def hist_header_bits(spark, sf_dir):
    return W.header_bits(W.histogram(syms(spark, sf_dir)))


@query(f"""WITH {HIST} SELECT ch, CAST(sum(n) AS BIGINT) AS symbols, CAST(sum(n) FILTER (bin = 0) AS BIGINT) AS without_bin,
    round(12.0 * sum(n) / sum(CASE WHEN bin = 0 THEN 17 WHEN bin < 4 THEN 2 WHEN bin < 8 THEN 4 ELSE 6 END * n), 6) AS ratio FROM hist GROUP BY ch""")
def compression_ratio(spark, sf_dir):
    """Bare 12-bit samples over a fixed code by bin: 17 bits without a bin, else 2, 4 or 6."""
    b, n = F.col("bin"), F.col("n")
    width = F.when(b == 0, 17).when(b < 4, 2).when(b < 8, 4).otherwise(6)
    out = W.histogram(syms(spark, sf_dir)).groupBy("ch").agg(F.sum("n").alias("symbols"), F.sum(F.when(b == 0, n)).alias("without_bin"), F.sum(width * n).alias("coded"))
    return out.select("ch", "symbols", "without_bin", F.round(12.0 * F.col("symbols") / F.col("coded"), 6).alias("ratio"))


@query(f"WITH {DELTAS} SELECT ch, pkt, seq, adc, delta FROM deltas")
def adc_delta(spark, sf_dir):
    return W.deltas(samples(spark, sf_dir)).select("ch", "pkt", "seq", "adc", "delta")


@query(f"WITH {SYMS} SELECT ch, pkt, seq, CAST(sym AS BIGINT) AS sym FROM syms")
def zigzag_symbols(spark, sf_dir):
    return syms(spark, sf_dir).select("ch", "pkt", "seq", F.col("sym").cast("long").alias("sym"))


@query(f"WITH {WAVES} SELECT vec_id, i, adc FROM waves")
def reconstruct_adc(spark, sf_dir):
    """Waveforms to symbols and back: the samples again."""
    rows = waves(spark, sf_dir)
    keys = ("vec_id",)
    return W.reconstruct(W.symbols(rows, keys, "i"), rows.filter("i = 0"), keys, "i").select("vec_id", "i", "adc")


@query(f"WITH {SAMPLES} SELECT ch, pkt, array_to_string(list(adc ORDER BY seq), ',') AS adcs FROM samples GROUP BY ch, pkt")
def transpose_channels(spark, sf_dir):
    return W.transpose(samples(spark, sf_dir)).select("ch", "pkt", F.array_join("adcs", ",").alias("adcs"))


@query(f"WITH {SAMPLES} SELECT ch, seq, adc FROM samples WHERE seq % 4 = 0")
def decimate(spark, sf_dir):
    return W.decimate(samples(spark, sf_dir), 4).select("ch", "seq", "adc")


@query(f"WITH {SAMPLES} SELECT ch, seq // 4 AS grp, CAST(sum(adc) // 4 AS BIGINT) AS mean FROM samples GROUP BY ch, seq // 4 HAVING count(*) = 4")
def decimate_avg(spark, sf_dir):
    return W.decimate_average(samples(spark, sf_dir), 4)


@query(f"WITH {SAMPLES} SELECT ch, seq, min(adc) OVER w AS low, max(adc) OVER w AS high FROM samples WINDOW w AS (PARTITION BY ch ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def running_extremes(spark, sf_dir):
    return W.running_extremes(samples(spark, sf_dir)).select("ch", "seq", "low", "high")


@query(f"WITH {SAMPLES} SELECT ch, bit, CAST(sum((adc >> CAST(bit AS INTEGER)) & 1) AS BIGINT) AS n FROM samples, (SELECT unnest(range(12)) AS bit) GROUP BY ch, bit")
def bit_occupancy(spark, sf_dir):
    return W.bit_counts(samples(spark, sf_dir))


@query(f"WITH {SAMPLES} SELECT ch, seq, adc FROM samples WHERE ch % 29 = 5")
def channel_select(spark, sf_dir):
    """One of up to 29 inputs."""
    return samples(spark, sf_dir).filter(F.col("ch") % 29 == 5).select("ch", "seq", "adc")


@query(f"""WITH {SAMPLES}, limits AS (SELECT ch, 20 + ch % 5 AS low, 200 - ch % 7 AS high FROM (SELECT DISTINCT ch FROM samples))
    SELECT ch, seq, adc, CASE WHEN adc < low THEN 'low' ELSE 'high' END AS alarm FROM samples JOIN limits USING (ch) WHERE adc < low OR adc > high""")
def threshold_alarm(spark, sf_dir):
    """Samples outside their channel's limits, which are a table of their own."""
    rows = samples(spark, sf_dir)
    limits = rows.select("ch").distinct().select("ch", (20 + F.col("ch") % 5).alias("low"), (200 - F.col("ch") % 7).alias("high"))
    alarm = F.when(F.col("adc") < F.col("low"), "low").otherwise("high")
    return rows.join(limits, "ch").filter("adc < low or adc > high").select("ch", "seq", "adc", alarm.alias("alarm"))


@query("""SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, string_agg(printf('%02x', (i + k + 8 * j) & 255), '' ORDER BY k) AS bytes
    FROM (SELECT unnest(range(1024)) AS i), (SELECT unnest(range(30)) AS j), (SELECT unnest(range(8)) AS k) GROUP BY i, j""")
def dummy_pattern(spark, sf_dir):
    return pattern(spark)


_PULSES = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(PULSE_MONO, PULSE_BIPOLAR, strict=True)))


@query(f"""WITH pulse(step, mono, bipolar) AS (VALUES {_PULSES}), grid AS (
        SELECT ch, n FROM (SELECT unnest(range(128)) AS ch), (SELECT unnest(range(256)) AS n))
    SELECT CAST(ch AS BIGINT) AS ch, CAST(n AS BIGINT) AS sample, CAST(coalesce(CASE WHEN ch % 3 = 2 THEN mono ELSE bipolar END, {PEDESTAL}) AS BIGINT) AS adc
    FROM grid LEFT JOIN pulse ON n % 64 = step""")
def emulator_pulse(spark, sf_dir):
    """128 channels with a pulse every 64 samples."""
    return emulator_pulses(spark, 256, 64)


_LEVELS = ", ".join(f"({d}, {j})" for d in (1, 2, 4, 8, 16) for j in range(16 // d))
TREES = f"""{HIST}, masks AS (SELECT ch, pkt, CAST(bit_or(CAST(1 AS BIGINT) << CAST(bin AS INTEGER)) AS BIGINT) AS mask FROM hist GROUP BY ch, pkt),
pairs AS (SELECT ch, pkt, mask, (mask >> (2 * j * d)) & ((1 << d) - 1) <> 0 AS r, (mask >> ((2 * j + 1) * d)) & ((1 << d) - 1) <> 0 AS l FROM masks, (VALUES {_LEVELS}) t(d, j)),
sizes AS (SELECT ch, pkt, mask, [32, sum(CASE WHEN r AND l THEN 2 WHEN r THEN 1 WHEN l THEN 2 ELSE 0 END), sum(CASE WHEN r AND l THEN 2 WHEN r THEN 2 WHEN l THEN 1 ELSE 0 END),
    sum(CASE WHEN r AND l THEN 1 WHEN r THEN 2 WHEN l THEN 2 ELSE 0 END)] AS s FROM pairs GROUP BY ch, pkt, mask)"""


@query(f"""WITH {TREES} SELECT ch, pkt, CAST(list_min(s) AS BIGINT) AS bits, CAST(CASE WHEN list_min(s) = s[2] THEN 1 WHEN list_min(s) = s[1] THEN 0 WHEN list_min(s) = s[3] THEN 2 ELSE 3 END AS BIGINT) AS scheme FROM sizes""")
def tree_sizes(spark, sf_dir):
    """How each packet's mask of occupied bins is coded shortest as a binary tree."""
    size = tree_size(F.col("mask"))
    return W.histogram_summary(W.histogram(syms(spark, sf_dir))).select("ch", "pkt", size["bits"].alias("bits"), size["scheme"].alias("scheme"))


@query(f"""WITH {HIST}, packets AS (SELECT ch, pkt, max(n) AS most FROM hist GROUP BY ch, pkt),
    every AS (SELECT p.ch, p.pkt, most, b, coalesce(h.n, 0) AS n FROM packets p CROSS JOIN range(32) r(b) LEFT JOIN hist h ON h.ch = p.ch AND h.pkt = p.pkt AND h.bin = r.b),
    rest AS (SELECT *, CAST(1023 - coalesce(sum(n) OVER (PARTITION BY ch, pkt ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_ FROM every),
    told AS (SELECT ch, pkt, most, string_agg(CASE WHEN w > 0 THEN lpad(bin(n), CAST(w AS INTEGER), '0') ELSE '' END, '' ORDER BY b) AS counts FROM (SELECT *, least({BITS.format('left_')}, {BITS.format('most')}) AS w FROM rest) GROUP BY ch, pkt, most),
    firsts AS (SELECT ch, pkt, arg_min(adc, seq) AS first FROM samples GROUP BY ch, pkt),
    overs AS (SELECT ch, pkt, coalesce(max({BITS.format('(sym - 32)')}) FILTER (sym >= 32), 0) AS over FROM syms GROUP BY ch, pkt)
    SELECT ch, pkt, lpad(bin(CAST((31 << 20) | ({BITS.format('most')} << 16) | ((first & 4095) << 4) | over AS BIGINT)), 32, '0') || counts AS header FROM told JOIN firsts USING (ch, pkt) JOIN overs USING (ch, pkt)""")
def histogram_header(spark, sf_dir):
    """The coded histogram of each packet, bit by bit."""
    return W.histogram_header(W.histogram(syms(spark, sf_dir)), _firsts(spark, sf_dir))


def _firsts(spark, sf_dir):
    over = F.max(F.when(F.col("sym") >= 32, F.length(F.bin(F.col("sym") - 32)) * (F.col("sym") > 32).cast("int")))
    found = W.deltas(samples(spark, sf_dir)).withColumn("sym", F.when(F.col("delta") > 0, 2 * F.col("delta")).otherwise(-2 * F.col("delta") + 1))
    return found.groupBy("ch", "pkt").agg(F.min_by("adc", "seq").alias("first"), F.coalesce(over, F.lit(0)).cast("long").alias("over_bits"))


@query(f"""WITH {HIST}, overs AS (SELECT ch, pkt, count(*) FILTER (sym >= 32) AS over, coalesce(max({BITS.format('(sym - 32)')}) FILTER (sym >= 32), 0) AS width FROM syms GROUP BY ch, pkt),
    t AS (SELECT *, sum(n) OVER (PARTITION BY ch, pkt) AS total, 1023 - coalesce(sum(n) OVER (PARTITION BY ch, pkt ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_
        FROM (SELECT p.ch, p.pkt, most, b, coalesce(h.n, 0) AS n FROM (SELECT ch, pkt, max(n) AS most FROM hist GROUP BY ch, pkt) p CROSS JOIN range(32) r(b) LEFT JOIN hist h ON h.ch = p.ch AND h.pkt = p.pkt AND h.bin = r.b)),
    u AS (SELECT ch, pkt, CAST(sum(n) AS BIGINT) AS symbols, CAST(32 + sum(least({BITS.format('CAST(left_ AS BIGINT)')}, {BITS.format('most')})) AS BIGINT) AS header, coalesce(sum(n * log2(total / n)) FILTER (n > 0), 0) AS code FROM t GROUP BY ch, pkt)
    SELECT ch, pkt, symbols, header + over * width + CAST(ceil(round(code, 6)) AS BIGINT) AS bits, round(12.0 * (symbols + 1) / (header + over * width + CAST(ceil(round(code, 6)) AS BIGINT)), 6) AS ratio FROM u JOIN overs USING (ch, pkt)""")
def coded_ratio(spark, sf_dir):
    """Bare 12-bit samples over what a packet is coded in: its histogram's bits, the overflow symbols' and those that an ideal coder needs."""
    bins = W.histogram(syms(spark, sf_dir))
    header = W.histogram_header(bins, _firsts(spark, sf_dir)).select("ch", "pkt", F.length("header").cast("long").alias("header"))
    over = W.overflow(syms(spark, sf_dir)).select("ch", "pkt", (F.col("over") * F.col("over_bits")).alias("over"))
    rows = W.entropy_bits(bins).join(header, ["ch", "pkt"]).join(over, ["ch", "pkt"], "left")
    bits = F.col("header") + F.coalesce("over", F.lit(0)) + F.ceil("bits")
    return rows.select("ch", "pkt", "symbols", bits.alias("bits"), F.round(12.0 * (F.col("symbols") + 1) / bits, 6).alias("ratio"))


@query("""SELECT o_orderkey, CAST(bit_count(w) AS BIGINT) AS ones, CAST(32 - (CASE WHEN w > 0 THEN length(ltrim(bin(w), '0')) ELSE 0 END) AS BIGINT) AS first, CAST(CASE WHEN w = 0 THEN 32 ELSE length(bin(w)) - length(rtrim(bin(w), '0')) END AS BIGINT) AS last,
    CAST((w >> 17) & 1023 AS BIGINT) AS taken FROM (SELECT o_orderkey, CAST((o_orderkey * 2654435761) % 4294967296 AS BIGINT) AS w FROM orders)""")
def bit_units(spark, sf_dir):
    """Set bits counted, the first one found from either side, a field taken from the left."""
    w = F.pmod(F.col("o_orderkey") * 2654435761, F.lit(1 << 32))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", w.alias("w"))
    return rows.select("o_orderkey", count_ones(F.col("w")).alias("ones"), find_first(F.col("w")).alias("first"), find_last(F.col("w")).alias("last"), extract_left(F.col("w"), 5, 10).alias("taken"))
