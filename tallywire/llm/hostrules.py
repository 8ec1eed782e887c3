"""Quality rules by host: what fails often on a host is held against its documents.

Five rules look at a document: few words, repeated runs of words, symbols, repeated lines, odd lengths of words. Their
failures are counted by host. A host's rate for a rule is shrunk towards all hosts' rate by a beta prior, whose weight is
fitted to how much the hosts differ (method of moments), so that a few documents condemn no host. Where a host's shrunk rate is
above ``strict``, its documents that fail that rule go; where it is above ``blocked``, the rule speaks for the host and all
of its documents go. A document that fails no rule is lost only with a blocked host, and rules that fail on a host here
and there are forgiven.

Spark expressions only. A text is looked at once, within its row: windows of words are hashed to 64 bits, and only texts in
which hashes are found twice sort them. Two different windows of a text have equal hashes with a chance of 5e-20 a pair. Counts are
written as a table, hosts are counted from it by partial sums, and verdicts come back by an equal join over the few hosts
that have any, dealt out over ``SALTS`` parts so that a host of any size is many tasks.

Defined cases: a null text has no words and fails the base; rows without a host are judged by the base alone, as no
verdict speaks for them; repeated rows count once each and are judged alike; an empty table gives an empty one; a line is
equal to another if all its characters are; texts of any length are looked at whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywire.llm.shared import written

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words in a window.
WINDOW = 5
#: Rules in order: name, and when a document with given counts fails it.
RULES = {
    "few_words": "n_words < 10",
    "repeated": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "lengths": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}
#: The rules a document must pass whatever its host.
BASE = ("few_words", "repeated")
#: Shrunk rates above which a host's documents must pass a rule, and above which they go.
STRICT, BLOCKED = 0.3, 0.9
#: Parts over which the documents of a host are dealt where its verdict is joined.
SALTS = 32


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, also where the body looks at it again for every item."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text: an array."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")


def repeated_words(found: Column, k: int = WINDOW) -> Column:
    """Words that lie in a window of k words found twice or more in an array of words."""

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def of(p: Column) -> Column:
            same = lambda j, i: F.get(p, j)["x"] == F.get(p, i)["x"]
            twice = F.filter(p, lambda s, j: F.coalesce(same(j - 1, j), F.lit(False)) | F.coalesce(same(j + 1, j), F.lit(False)))
            at = F.sort_array(F.transform(twice, lambda s: s["i"]))
            # each place covers k words, or those up to the next place
            return _let(at, lambda a: F.aggregate(F.transform(a, lambda x, j: F.least(F.lit(k), F.coalesce(F.get(a, j + 1) - x, F.lit(k)))), F.lit(0), lambda s, x: s + x))

        return _let(placed, of)

    def count(hashes: Column) -> Column:
        n = F.size(hashes) - (k - 1)
        windows = F.slice(F.transform(hashes, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, k)])), F.lit(1), n)
        return F.when(n < 2, 0).otherwise(_let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == n, 0).otherwise(covered(w))))

    return _let(F.transform(found, lambda w: F.xxhash64(w)), count).cast("long")


def counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None) -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words): a row for each document."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    host = F.col("source") if host is None else host
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), host.cast("string").alias("host"), text.alias("text"))
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again"))
    length = lambda without: F.length(F.translate("text", without, "")).cast("long")
    looked = rows.select("id", "host", _let(words(F.col("text")), of_words).alias("w"), _let(lines, of_lines).alias("l"), length(BLANKS).alias("word_chars"), (F.length("text").cast("long") - length(SYMBOLS)).alias("n_symbols"))
    return looked.select(
        "id", "host", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.n").alias("n_lines"), F.col("l.again").alias("n_dup_lines"), F.col("w.repeated").alias("n_repeat_words")
    )


def host_rates(counted: DataFrame) -> DataFrame:
    """(host, rule, n, failed, rate, shrunk): a row for each host and rule; rows without a host are left out.

    Of hosts with n documents of which f fail, all rates being drawn from one beta distribution of mean m, the spread
    sum(n (f/n - m)^2) is expected to be m (1 - m) ((h - 1) + r (N - sum(n^2)/N - (h - 1))) for h hosts and N documents. That gives
    the share r, and the prior's weight is 1/r - 1 documents: hosts that differ by chance alone get the common rate."""
    by_host = counted.filter(F.col("host").isNotNull()).groupBy("host")
    fails = [F.sum(F.expr(failed).cast("long")).alias(name) for name, failed in RULES.items()]
    one = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("failed")) for name in RULES])).alias("x")
    rates = by_host.agg(F.count("*").alias("n"), *fails).select("host", "n", one).select("host", "n", "x.rule", "x.failed")
    n, f = F.col("n").cast("double"), F.col("failed").cast("double")
    total = rates.groupBy("rule").agg(F.count("*").alias("h"), F.sum("n").alias("N"), F.sum("failed").alias("F"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ff"))
    m, free = F.col("F") / F.col("N"), F.col("h") - 1
    chance = m * (1 - m)
    spread = F.col("ff") - F.col("F") * m
    share = F.try_divide(F.try_divide(spread, chance) - free, F.col("N") - F.col("nn") / F.col("N") - free)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(share, F.lit(0.0))))
    prior = total.select("rule", m.alias("m"), share.alias("share"))
    # with a weight of 1/share - 1: (failed + weight m) / (n + weight), both sides times the share
    shrunk = (F.col("failed") * F.col("share") + (1 - F.col("share")) * F.col("m")) / (F.col("n") * F.col("share") + 1 - F.col("share"))
    return rates.join(F.broadcast(prior), "rule").select("host", "rule", "n", "failed", (F.col("failed") / F.col("n")).alias("rate"), shrunk.alias("shrunk"))


def host_verdicts(rates: DataFrame, *, strict: float = STRICT, blocked: float = BLOCKED) -> DataFrame:
    """(host, strict array of rules, blocked boolean): the hosts that have any verdict."""
    rule = F.when(F.col("shrunk") > strict, F.col("rule"))
    said = rates.groupBy("host").agg(F.sort_array(F.collect_list(rule)).alias("strict"), F.max(F.col("shrunk") > blocked).alias("blocked"))
    return said.filter(F.size("strict") > 0)


def judge(docs: DataFrame, *, strict: float = STRICT, blocked: float = BLOCKED, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None) -> DataFrame:
    """A row for each document: id, host, counts, base_failed, failed (rules), host_strict (rules), host_blocked, kept."""
    counted = written(counts(docs, id_col=id_col, text_col=text_col, host=host), "counts")
    verdicts = host_verdicts(host_rates(counted), strict=strict, blocked=blocked)
    salt = F.pmod(F.xxhash64("id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    copies = verdicts.select(F.col("host").alias("_host"), "strict", "blocked", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"))
    rows = counted.withColumn("_salt", salt)
    met = rows.join(copies, (rows["host"] == copies["_host"]) & (rows["_salt"] == copies["_part"]), "left")
    failed = F.filter(F.array(*[F.when(F.expr(fails), F.lit(name)) for name, fails in RULES.items()]), lambda x: x.isNotNull())
    base = reduce(lambda a, b: a | b, [F.expr(RULES[name]) for name in BASE])
    none = F.array().cast("array<string>")
    judged = met.select(
        F.col("id").alias(id_col), "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), failed.alias("failed"), F.coalesce("strict", none).alias("host_strict"), F.coalesce("blocked", F.lit(False)).alias("host_blocked"),
    )
    return judged.withColumn("kept", ~(F.col("base_failed") | F.col("host_blocked") | F.arrays_overlap("failed", "host_strict")))


def op13_quality(spark, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS row, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), parts AS (
    SELECT row, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
    FROM texts
), windows AS (
    SELECT row, i, w[i:i + 4] AS x FROM (SELECT row, w, unnest(generate_series(1, len(w) - 4)) AS i FROM parts)
), repeated AS (
    SELECT row, count(DISTINCT i + j) AS n FROM (SELECT row, i, count(*) OVER (PARTITION BY row, x) AS c FROM windows), generate_series(0, 4) AS s(j)
    WHERE c > 1 GROUP BY row
), counted AS (
    SELECT row, doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM parts LEFT JOIN repeated USING (row)
), ruled AS (
    SELECT *, n_words < 10 AS few_words, 100 * n_repeat_words > 20 * n_words AS repeated, 10 * n_symbols > n_words AS symbols,
        10 * n_dup_lines > 3 * n_lines AS lines, word_chars < 3 * n_words OR word_chars > 10 * n_words AS lengths
    FROM counted
), failures AS (
    SELECT row, host, rule, fails FROM ruled UNPIVOT (fails FOR rule IN (few_words, repeated, symbols, lines, lengths))
), hosts AS (
    SELECT host, rule, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(fails AS INT)) AS DOUBLE) AS f FROM failures WHERE host IS NOT NULL GROUP BY ALL
), moments AS (
    SELECT rule, sum(f) / sum(n) AS m, count(*) - 1 AS free, sum(f * f / n) - sum(f) * sum(f) / sum(n) AS spread, sum(n) - sum(n * n) / sum(n) AS size
    FROM hosts GROUP BY rule
), prior AS (
    SELECT rule, m, least(1, greatest(0, coalesce((spread / nullif(m * (1 - m), 0) - free) / nullif(size - free, 0), 0))) AS share FROM moments
), judged AS (
    SELECT host, rule, (f * share + (1 - share) * m) / (n * share + 1 - share) AS shrunk FROM hosts JOIN prior USING (rule)
), lost AS (
    SELECT DISTINCT row FROM failures JOIN judged USING (host, rule) WHERE shrunk > 0.9 OR (fails AND shrunk > 0.3)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeated AS base_failed,
    NOT (few_words OR repeated OR row IN (SELECT row FROM lost)) AS kept
FROM ruled
"""
