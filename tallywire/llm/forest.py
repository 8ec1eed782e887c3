"""Neighbours and regions in sorted label sequences: the search of a forest, whatever its labels are made of.

A tree is label sequences in sorted order: rows that share the longest common prefix stand next to each other. A region of
depth d is a run of rows that share their first d labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a tree that are looked at together.
BLOCK_ROWS = 1 << 15


def shared_labels(tree: np.ndarray, labels: np.ndarray, widths: list[int]) -> np.ndarray:
    """Of sorted rows, how many labels each shares with the next one; 0 across trees."""
    same, shared, at = tree[1:] == tree[:-1], np.zeros(max(0, len(tree) - 1), dtype=np.int64), 0
    for width in widths:
        same = same & (labels[1:, at : at + width] == labels[:-1, at : at + width]).all(axis=1)
        shared += same
        at += width
    return shared


def regions(shared: np.ndarray, group: np.ndarray, most: int, shallowest: int, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a block of sorted rows: the depth of each row's region, 0 where none is known to be whole; and where the region
    ends, or the next row if it holds one component only and has nothing to compare."""
    size = len(group)
    depth, end = np.zeros(size, dtype=np.int64), np.arange(1, size + 1)
    left = np.ones(size, dtype=bool)
    for d in range(shallowest, deepest + 1):
        start = np.flatnonzero(np.append(True, shared < d))
        stop = np.append(start[1:], size)
        pure = np.minimum.reduceat(group, start) == np.maximum.reduceat(group, start)
        whole = (start > 0) & (stop < size) & (pure | (stop - start <= most))
        over = lambda x: np.repeat(x, stop - start)  # noqa: B023, E731
        found = over(whole) & left
        depth[found] = d
        end = np.where(found & ~over(pure), over(stop), end)
        left &= ~found
        if not left.any():
            break
    return depth, end


def equal_samples(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of 64-bit sketches, how many of their 16 half-bytes are equal."""
    differ = a ^ b
    differ |= differ >> np.uint64(2)
    differ |= differ >> np.uint64(1)
    return 16 - np.bitwise_count(differ & np.uint64(0x1111111111111111))


def looked_up(rows: DataFrame, widths: list[int], shallowest: int, most: int, percent: int, equal: int = 0, depths: bool = True) -> DataFrame:
    """Candidates among rows (tree, labels, id, n, component) of a forest, as rows (u, v, depth). ``labels`` is binary, of labels of
    the given widths in bytes. With ``equal`` a sketch of 8 bytes follows them, 16 samples of half a byte: pairs with fewer
    than ``equal`` equal ones are left out before they are shuffled.

    Pairs (u, v), with ``depth`` null, are of different components: neighbours, and all of a region of at most ``most`` rows.
    Pairs whose sizes n alone rule out the similarity are left out. Rows (u, null, depth) tell the depth of the region of u in
    one tree, where it is not the shallowest; 0 stands for no region. Without ``depths`` they are not made.
    """
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("u", kind), T.StructField("v", kind), T.StructField("depth", T.IntegerType())])
    ordered = rows.repartitionByRange("tree", "labels", "id").sortWithinPartitions("tree", "labels", "id")

    def block(batches: list[pa.RecordBatch], arrow: pa.Schema):
        table = pa.Table.from_batches(batches).combine_chunks()
        size = table.num_rows
        labels = np.frombuffer(b"".join(table["labels"].to_pylist()), dtype=np.uint8).reshape(size, sum(widths) + (8 if equal else 0))
        sketch = np.ascontiguousarray(labels[:, -8:]).view(np.uint64)[:, 0] if equal else None
        n, ids = table["n"].to_numpy(), table["id"].combine_chunks()
        group = table["component"].combine_chunks().dictionary_encode().indices.to_numpy()
        shared = shared_labels(table["tree"].to_numpy(), labels, widths)
        near = np.arange(size) + 1
        near[:-1] += shared >= shallowest
        if most:
            depth, end = regions(shared, group, most, shallowest, len(widths))
            short = np.flatnonzero(depth != shallowest)
            if depths and len(short):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(short)), pa.nulls(len(short), ids.type), pa.array(depth[short], pa.int32())], schema=arrow)
            near = np.maximum(near, end)
        left, right, a, w = [], [], np.arange(size), 0
        while len(a):
            w += 1
            a = a[a + w < near[a]]
            b = a + w
            take = (group[a] != group[b]) & (100 * n[a] >= percent * n[b]) & (100 * n[b] >= percent * n[a])
            if equal:
                take &= equal_samples(sketch[a], sketch[b]) >= equal
            left.append(a[take])
            right.append(b[take])
        a, b = np.concatenate(left), np.concatenate(right)
        if len(a):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.nulls(len(a), pa.int32())], schema=arrow)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held, size = to_arrow_schema(schema), [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield from block(held, arrow)
                held, size = [], 0
        if size:
            yield from block(held, arrow)

    return ordered.mapInArrow(run, schema)


def candidate_pairs(found: DataFrame) -> DataFrame:
    return found.filter("v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
