"""Helpers shared by the Arrow-batched operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step inside a task works on at a time.
STEP_BYTES = 2 << 20


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns, renamed: ``narrow(df, id="doc_id")``. Extra columns can then not clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def id_type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def parts(batch: pa.RecordBatch, limit: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about ``limit`` bytes in a column of texts: only one run at a time becomes objects."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def map_steps(df: DataFrame, work: Callable[[list, list], Iterable[dict | None]], schema: str | T.StructType, limit: int = STEP_BYTES) -> DataFrame:
    """Apply ``work(ids, texts)`` to bounded runs of a frame (id, text); it returns columns by name."""
    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, limit):
                out = work(part.column(0).to_pylist(), part.column(1).to_pylist())
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
