"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; runs of one role are cut out of the array and joined to
blocks; blocks are joined to the formatted text::

    <|begin|><|start|>user<|text|>first turn<|turn|>second turn<|end|><|start|>assistant<|text|>answer<|end|>

Every control string holds ``<``. Inside roles and texts a backslash, ``<`` and ``[`` are written ``\\\\``, ``\\l`` and
``\\b``, so that neither these nor other templates' control strings can stand there, and reading undoes it. The loss
mask is kept as segments: their texts, joined, are the formatted text, and a flag marks those that count for the loss.

A conversation is one row of output, so it is gathered whole; all array steps are linear in its turns.

Defined cases: null texts and roles are empty; turns are ordered by turn, role, text (nulls first), so repeated rows
and ties have a fixed order and each is kept; rows without a conv_id form one conversation; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, START, TEXT, TURN, END = "<|begin|>", "<|start|>", "<|text|>", "<|turn|>", "<|end|>"


def escape(text: Column) -> Column:
    for plain, written in (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    """Undo escape: pairs of backslashes stand for themselves, the others begin a mark."""
    parts = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))), "\\")


def format_chats(turns: DataFrame, *, loss_role: str = "assistant", id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation: the id column, formatted, segments array<struct<text, loss>>."""
    said = F.struct(
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    gathered = turns.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.sort_array(F.collect_list(said)).alias("said"))
    last = F.size("said") - 1
    begins = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get("said", i)["role"] != F.get("said", i - 1)["role"]))
    gathered = gathered.withColumn("begins", begins)

    def block(begin: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("begins", k + 1), F.size("said"))
        same = F.slice("said", begin + 1, stop - begin)
        role = F.get("said", begin)["role"]
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = part(F.concat(F.lit(START), escape(role), F.lit(TEXT)), F.lit(False))
        texts = F.flatten(F.transform(same, lambda t, j: F.array(part(F.when(j > 0, TURN).otherwise(""), F.lit(False)), part(escape(t["text"]), role == loss_role))))
        return F.concat(F.array(head), texts, F.array(part(F.lit(END), F.lit(False))))

    begin = F.array(F.struct(F.lit(BEGIN).alias("text"), F.lit(False).alias("loss")))
    segments = F.concat(begin, F.flatten(F.transform("begins", block)))
    made = gathered.select("id", segments.alias("segments"))
    return made.select(F.col("id").alias(id_col), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_chats(formatted: Column) -> Column:
    """The turns of a formatted text: array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, r"<\|start\|>", -1), lambda _, k: k > 0)

    def turns(block: Column) -> Column:
        parts = F.split(block, r"<\|text\|>", 2)
        role = unescape(F.get(parts, F.lit(0)))
        texts = F.split(F.regexp_replace(F.get(parts, F.lit(1)), r"<\|end\|>$", ""), r"<\|turn\|>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def op8_chat(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    marks = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    chats = format_chats(table.unionByName(marks))
    read = chats.select("conv_id", "formatted", read_chats(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: formatted_chars counts control strings too: 9 for the beginning, 24 and the role for each run of a role, 8 for each
#: further turn of a run, and one more for each escaped character.
ORACLE_SQL = """
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), placed AS (
    SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS begins FROM said
)
SELECT conv_id,
    CAST(count(*) AS BIGINT) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(9 + sum(CASE WHEN begins THEN 24 + length(regexp_replace(role, '([\\\\<\\[])', 'xx', 'g')) ELSE 8 END
        + length(regexp_replace(text, '([\\\\<\\[])', 'xx', 'g'))) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
