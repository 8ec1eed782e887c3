"""Binary files read and written by byte ranges: a file of any size is many tasks.

``fixed_records`` is a data source of records of a fixed number of little-endian words. Its partitions are (path, offset, length),
cut at record borders, so that a task reads its own range and no more; a rest that fills no record ends a file. Writing
makes a file for each task under a name of its own, which is given its final name when the job is committed, so that a lost
task leaves nothing behind that a reader would take up.

Files are opened by pyarrow's file systems (local or mounted folders, hdfs, s3, gs), as executors do; names that begin with
``_`` or ``.`` are not data.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a partition, and of what is held of it at a time.
SPLIT, STEP = 64 << 20, 8 << 20
#: Words by name: numpy's type and Spark's.
KINDS = {"u16": ("<u2", T.IntegerType()), "i64": ("<i8", T.LongType())}


def opened(path: str) -> tuple[Any, str]:
    """The file system of a path, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def sizes(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the data files of a folder, in order."""
    from pyarrow import fs

    system, place = opened(path)
    info = system.get_file_info(place)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True)) if info.type == fs.FileType.Directory else []
    if not found and info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    begin = path[: len(path) - len(place)] if path.endswith(place) else "file://"
    hidden = lambda p: any(part[:1] in ("_", ".") for part in p[len(place) :].split("/"))
    return sorted((begin + f.path, f.size) for f in found if f.type == fs.FileType.File and not (f.path != place and hidden(f.path)))


def read_range(path: str, offset: int, length: int) -> bytes:
    system, place = opened(path)
    with system.open_input_file(place) as file:
        return file.read_at(length, offset)


@dataclass
class Range(InputPartition):
    """Bytes of a file; ``path`` None is a partition of nothing."""

    path: str | None
    offset: int = 0
    length: int = 0


class FixedRecords(DataSource):
    """Options: path; word, a name of KINDS; words, of a record; split, bytes of a partition (default 64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> T.StructType:
        fields = [("file", T.StringType()), ("n", T.LongType()), ("words", T.ArrayType(KINDS[self.options["word"]][1]))]
        return T.StructType([T.StructField(n, t) for n, t in fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        import numpy as np

        self.path, self.word, self.words = options["path"], options["word"], int(options["words"])
        self.size = self.words * np.dtype(KINDS[self.word][0]).itemsize
        self.split = max(1, int(options.get("split", SPLIT)) // self.size) * self.size

    def partitions(self) -> list[Range]:
        ranges = []
        for path, size in sizes(self.path):
            whole = size - size % self.size
            ranges += [Range(path, at, min(self.split, whole - at)) for at in range(0, whole, self.split)]
        return ranges or [Range(None)]

    def read(self, partition: Range) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if partition.path is None:
            return
        system, place = opened(partition.path)
        kind, held = KINDS[self.word][0], max(1, STEP // self.size) * self.size
        value = pa.int64() if self.word == "i64" else pa.int32()
        with system.open_input_file(place) as file:
            for at in range(partition.offset, partition.offset + partition.length, held):
                raw = file.read_at(min(held, partition.offset + partition.length - at), at)
                flat = np.frombuffer(raw, dtype=kind)
                rows = len(flat) // self.words
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * self.words), pa.array(flat.astype("<i4") if self.word == "u16" else flat, value))
                number = pa.array(at // self.size + np.arange(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * rows, pa.string()), number, lists], names=["file", "n", "words"])


@dataclass
class Written(WriterCommitMessage):
    """A task's file, before it has its final name."""

    name: str


class _Files(DataSourceArrowWriter):
    """One file for each task, by its final name only once the job is committed."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.job = options["path"], uuid.uuid4().hex[:8]
        if overwrite:
            raise ValueError("files are only ever added to a folder")

    def bytes_of(self, batch: Any) -> bytes:
        raise NotImplementedError

    def write(self, iterator: Iterator) -> Written:
        system, place = opened(self.path)
        system.create_dir(place, recursive=True)
        name = f"{uuid.uuid4().hex}"
        with system.open_output_stream(posixpath.join(place, f"_{name}")) as out:
            for batch in iterator:
                out.write(self.bytes_of(batch))
        return Written(name)

    def commit(self, messages: list) -> None:
        system, place = opened(self.path)
        for n, message in enumerate(m for m in messages if m is not None):
            system.move(posixpath.join(place, f"_{message.name}"), posixpath.join(place, f"part-{n:05d}-{self.job}.bin"))

    def abort(self, messages: list) -> None:
        system, place = opened(self.path)
        for message in messages:
            if message is not None:
                system.delete_file(posixpath.join(place, f"_{message.name}"))


class _Writer(_Files):
    def __init__(self, options: dict, overwrite: bool) -> None:
        super().__init__(options, overwrite)
        self.kind, self.words = KINDS[options["word"]][0], int(options["words"])

    def bytes_of(self, batch: Any) -> bytes:
        import numpy as np

        records = batch.column(batch.schema.get_field_index("words"))
        if records.null_count or any(n != self.words for n in records.value_lengths().unique().to_pylist()):
            raise ValueError(f"a record has {self.words} words")
        flat = records.flatten()
        if flat.null_count:
            raise ValueError("a word is null")
        flat = flat.to_numpy(zero_copy_only=False)
        made = flat.astype(self.kind)
        if not np.array_equal(made, flat):
            raise ValueError("a value does not fit its word")
        return made.tobytes()


class ByteStream(DataSource):
    """Writes the binaries of a column ``data`` one after another. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "byte_stream"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Bytes(self.options, overwrite)


class _Bytes(_Files):
    def bytes_of(self, batch: Any) -> bytes:
        return b"".join(x for x in batch.column(batch.schema.get_field_index("data")).to_pylist() if x)


def _registered(spark: SparkSession, source: type[DataSource]) -> str:
    spark.dataSource.register(source)
    return source.name()


def read_fixed(spark: SparkSession, path: str, *, word: str, words: int, split: int = SPLIT) -> DataFrame:
    """(file, n, words): records of files, each numbered within its file."""
    reader = spark.read.format(_registered(spark, FixedRecords)).option("word", word).option("words", words).option("split", split)
    return reader.load(path)


def write_fixed(records: DataFrame, path: str, *, word: str, words: int, column: str = "words") -> None:
    """A column of arrays as records: a file for each partition, in the order of its rows."""
    kind = T.ArrayType(KINDS[word][1])
    rows = records.select(records[column].cast(kind).alias("words"))
    rows.write.format(_registered(records.sparkSession, FixedRecords)).option("word", word).option("words", words).mode("append").save(path)


def write_bytes(rows: DataFrame, path: str, *, column: str = "data") -> None:
    """A column of binaries, one after another: a file for each partition, in the order of its rows."""
    rows.select(rows[column].cast("binary").alias("data")).write.format(_registered(rows.sparkSession, ByteStream)).mode("append").save(path)
