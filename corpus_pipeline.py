"""A corpus pipeline of four stages: language identification, line dedup, near-duplicate removal, packing.

Each stage takes the documents that the one before it kept and returns a table with the same columns; the last one
returns pieces of packed windows. Every stage works on whole texts and on all documents it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywire.llm.langid import fit, held_out, in_language
from tallywire.llm.linededup import NOT_BLANK, dedup_lines
from tallywire.llm.minhash import near_duplicates
from tallywire.llm.packing import pack
from tallywire.llm.shared import written

#: A text whose main language has less than this share of it, by letters and likelihood, is rejected.
LEAST_LANGUAGE_SCORE = 0.4
#: Begins the names of columns that only pass through a stage.
MARK = "_stage_"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learnt, from two thirds of the labelled ones; mixtures without a main language and
    texts without letters go.

    Null, empty and letterless texts go; null labels and ids do no harm; repeated rows stay or go together; an empty table,
    or one without a label, gives an empty table; other columns are kept as they are."""
    model = fit(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    return in_language(docs, model, least_score=LEAST_LANGUAGE_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document, or an earlier place, holds, equal ones of any length; those
    of which nothing but blanks is left go.

    Null, empty and blank texts stay, as they lose nothing; rows without an id come first; repeated rows lose the same
    lines; an empty table gives an empty one; other columns are kept as they are, but n_chars follows the text."""
    found = dedup_lines(docs, prefix=MARK)
    dropped = F.col(f"{MARK}dropped_lines") > 0
    left = found.filter(~dropped | F.col("text").rlike(NOT_BLANK))
    n_chars = F.when(dropped, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, a similarity of 0.8.

    Texts that are null or without words stay, and so do rows without an id; repeated rows stay or go together; an empty
    table gives an empty one; other columns are kept as they are."""
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias(f"{MARK}id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[f"{MARK}id"]), "left_semi")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of at most 4096 tokens: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A null text is an empty one, which is its closing id alone; repeated rows are packed once each; an empty table gives no
    pieces; other columns are ignored."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Windows depend on how the input is split and language scores on a fitted model, which SQL cannot express.
ORACLE_SQL = None
