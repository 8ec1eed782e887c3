"""Record decoders of the user's, by type of record: a table function joined to each record.

A decoder is a function of a record's bytes that gives (name, value) pairs. Decoders are registered under the types they are for; a lateral
join calls, for each record, the one of its type, in the task that holds the record. ::

    decode = decoders(spark, {1: status_fields, 2: counters})
    decoded(records, decode)                                             # (…, name, value)
    spark.sql("SELECT r.n, d.* FROM records r, LATERAL decode_record(r.type, r.payload) d")

Defined cases: a type without a decoder, a null type or payload give no rows; a decoder's error is a row named ``error`` with its
message, so that one damaged record does not end a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

Decoder = Callable[[bytes], Iterable[tuple[str, object]]]


def decoders(spark: SparkSession, by_type: dict[int, Decoder], name: str = "decode_record") -> UserDefinedTableFunction:
    """The table function ``name(type, payload)`` of these decoders, for SQL too."""

    class Decode:
        def eval(self, kind: int, payload: bytes):  # noqa: ANN202
            decode = by_type.get(kind)
            if decode is None or payload is None:
                return
            try:
                for field, value in decode(bytes(payload)):
                    yield field, None if value is None else str(value)
            except Exception as error:  # noqa: BLE001
                yield "error", f"{type(error).__name__}: {error}"

    made = F.udtf(Decode, returnType="name string, value string")
    spark.udtf.register(name, made)
    return made


def decoded(records: DataFrame, decode: UserDefinedTableFunction, *, kind: str = "type", payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """(records' columns, name, value): a row for each field that a record's decoder finds."""
    outer: list[Column] = [F.col(c).outer() for c in (kind, payload)]
    joined = records.lateralJoin(decode(*outer))
    return joined.select(*(keep if keep is not None else records.columns), "name", "value")
