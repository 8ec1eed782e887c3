"""Queries of this subpackage by name, and the DuckDB SQL each agrees with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywire.llm.bpe import op2_bpe
from tallywire.llm.chat import ORACLE_SQL as CHAT_SQL
from tallywire.llm.chat import op8_chat
from tallywire.llm.editembed import op9_fingerprints
from tallywire.llm.hostrules import ORACLE_SQL as RULES_SQL
from tallywire.llm.hostrules import op13_quality
from tallywire.llm.infill import ORACLE_SQL as INFILL_SQL
from tallywire.llm.infill import op12_fim
from tallywire.llm.langid import op3_language_id
from tallywire.llm.lexical import ORACLE_SQL as SEARCH_SQL
from tallywire.llm.lexical import op11_search
from tallywire.llm.linededup import ORACLE_SQL as LINE_SQL
from tallywire.llm.linededup import op6_line_dedup
from tallywire.llm.minhash import ORACLE_SQL as NEAR_SQL
from tallywire.llm.minhash import op1_minhash
from tallywire.llm.ogg import op5_ogg
from tallywire.llm.packing import op4_packing
from tallywire.llm.tokencount import op10_token_counts
from tallywire.llm.warc import ORACLE_SQL as WARC_SQL
from tallywire.llm.warc import op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_bpe": op2_bpe,
    "op3_language_id": op3_language_id,
    "op4_packing": op4_packing,
    "op5_ogg": op5_ogg,
    "op6_line_dedup": op6_line_dedup,
    "op7_warc": op7_warc,
    "op8_chat": op8_chat,
    "op9_fingerprints": op9_fingerprints,
    "op10_token_counts": op10_token_counts,
    "op11_search": op11_search,
    "op12_fim": op12_fim,
    "op13_quality": op13_quality,
}
ORACLES: dict[str, str] = {
    "op1_minhash": NEAR_SQL,
    "op6_line_dedup": LINE_SQL,
    "op7_warc": WARC_SQL,
    "op8_chat": CHAT_SQL,
    "op11_search": SEARCH_SQL,
    "op12_fim": INFILL_SQL,
    "op13_quality": RULES_SQL,
}
