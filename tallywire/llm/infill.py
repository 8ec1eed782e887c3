"""Fill-in-the-middle: a text is cut at two places and its parts change places, so that a model learns to fill a gap.

A batch of texts is one run of bytes, as Arrow stores it, and a numpy kernel cuts all of its rows together: a table
gives the class of each byte, a second one tells from the classes of two adjacent bytes whether a unit begins between them,
a sum over these marks counts units, less what came before each document, and one binary search over the sum finds the
places of all cuts. The parts are slices of the same bytes, and are joined by Arrow.

A cut lies after the smaller and the larger of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units, where h1 to h4 are the first four
groups of eight hexadecimal digits of the SHA-256 of ``seed:id``. Forms::

    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle
    plain  the text: empty, or with a mark in it, or left as it is by chance

Nothing is shuffled; a step holds a few bytes for each byte of about two megabytes of texts, or of one longer text.

Defined cases: a null text is empty, hence plain; a null id counts as an empty one; rows with one id are cut at the same
shares, repeated rows alike; an empty table gives an empty one; texts of any length are cut whole; extra columns are
ignored, so their names can not clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.llm.arrow import STEP_BYTES, id_type, parts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Classes of bytes: the inside of a code point, blanks, all that begins another code point.
INSIDE, BLANK, OTHER = 0, 1, 2
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[0x80:0xC0] = INSIDE
_CLASS[[0x20, *range(0x09, 0x0E)]] = BLANK
#: By units, whether one begins between bytes of two classes: [class before, class after]. Words take the blanks before them.
_BEGINS = {
    "chars": np.array([[False, True, True]] * 3),
    "words": np.array([[False, True, False], [False, False, False], [False, True, False]]),
}
#: The mark's middle bytes; a mark is one of them between < and >.
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord("P"), ord("S"), ord("M")]] = True


def unit_starts(data: np.ndarray, offsets: np.ndarray, units: str) -> np.ndarray:
    """For each byte, whether a unit begins with it; a document's first byte always begins one."""
    kind = _CLASS[data]
    starts = np.empty(len(data), dtype=bool)
    starts[1:] = _BEGINS[units][kind[:-1], kind[1:]]
    firsts = offsets[:-1]
    starts[firsts[firsts < offsets[1:]]] = True
    return starts


def marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each document, whether it holds a mark."""
    found = np.zeros(len(offsets) - 1, dtype=bool)
    if len(data) > 2:
        at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & _MARK[data[1:-1]])
        of = np.searchsorted(offsets, at, side="right") - 1
        found[of[at + 2 < offsets[of + 1]]] = True
    return found


def cut(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, units: str = "chars") -> tuple[np.ndarray, ...]:
    """Of documents ``data[offsets[i]:offsets[i + 1]]``: units n, units before both cuts, and the bytes at which these lie."""
    total = np.cumsum(unit_starts(data, offsets, units), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    before = np.concatenate([[0], total])[offsets].astype(np.int64)
    n = np.diff(before)
    a, b = h1 % (n + 1), h2 % (n + 1)
    a, b = np.minimum(a, b), np.maximum(a, b)
    # unit k of a document is the unit before + k of the batch; one past its last is the next document's first, where it ends
    at = np.searchsorted(total, np.concatenate([before[:-1] + a, before[:-1] + b]) + 1, side="left")
    at = np.clip(at, np.tile(offsets[:-1], 2), np.tile(offsets[1:], 2))
    return n, a, b, at[: len(n)], at[len(n) :]


def _slices(texts: pa.Array, edges: np.ndarray) -> list[pa.Array]:
    """Columns of an array of texts cut at byte edges [row, edge], over the same bytes."""
    flat = np.ascontiguousarray(edges, dtype=np.int64).ravel()
    rows, width = edges.shape
    bounds = np.empty(rows * (width - 1) + 1, dtype=np.int64)
    bounds[:-1] = edges[:, :-1].ravel()
    bounds[-1] = flat[-1] if rows else 0
    kind = texts.type
    every = pa.Array.from_buffers(kind, rows * (width - 1), [None, pa.py_buffer(bounds), texts.buffers()[2]])
    index = np.arange(rows, dtype=np.int64) * (width - 1)
    return [every.take(pa.array(index + i)) for i in range(width - 1)]


def _cut_batch(batch: pa.RecordBatch, units: str, fim_percent: int, spm_percent: int, schema: pa.Schema) -> pa.RecordBatch:
    given = batch.column(1)
    texts = pa.concat_arrays([pc.fill_null(given, "").cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[: offsets[-1]] if held is not None else np.zeros(0, dtype=np.uint8)
    h1, h2, h3, h4 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6))
    n, a, b, at, to = cut(data, offsets, h1, h2, units)
    plain = (n == 0) | marked(data, offsets) | (h3 % 100 >= fim_percent)
    spm = ~plain & (h4 % 100 < spm_percent)
    form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string())
    if held is None:
        output = texts
    else:
        pre, mid, suf = _slices(texts, np.stack([offsets[:-1], at, to, offsets[1:]], axis=1))
        p, s, m, none = (pa.scalar(x, texts.type) for x in (PREFIX, SUFFIX, MIDDLE, ""))
        psm = pc.binary_join_element_wise(p, pre, s, suf, m, mid, none)
        turned = pc.binary_join_element_wise(s, suf, p, pre, m, mid, none)
        output = pc.if_else(pa.array(plain), texts, pc.if_else(pa.array(spm), turned, psm))
    number = lambda x: pa.array(x, pa.int64(), mask=plain)
    made = [batch.column(0), output.cast(pa.string()), form, pa.array(n, pa.int64()), number(a), number(b - a)]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def fill_in_middle(
    docs: DataFrame, *, seed: int = 1, units: str = "chars", fim_percent: int = 90, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, output, form, n, prefix_units, middle_units): every text, ``fim_percent`` of a hundred cut, ``spm_percent`` of these with the
    suffix first. ``units`` are chars (code points) or words."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if units not in _BEGINS:
        raise ValueError(f"units are one of {sorted(_BEGINS)}, not {units!r}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256)
    groups = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *groups)
    fields = [T.StructField(id_col, id_type(docs, id_col)), T.StructField("output", T.StringType()), T.StructField("form", T.StringType())]
    schema = T.StructType(fields + [T.StructField(c, T.LongType()) for c in ("n", "prefix_units", "middle_units")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, STEP_BYTES):
                yield _cut_batch(part, units, fim_percent, spm_percent, arrow)

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of."""
    at = F.split(output, "<[PSM]>", -1)
    first, second, third = (F.get(at, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)


def op12_fim(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE_SQL = """
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
), drawn AS (
    SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
            WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM hashed
), parts AS (
    SELECT *, substr(text, 1, least(x, y)) AS pre, substr(text, least(x, y) + 1, greatest(x, y) - least(x, y)) AS mid, substr(text, greatest(x, y) + 1) AS suf
    FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(least(x, y) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(greatest(x, y) - least(x, y) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END)
        AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""
