"""Connected components by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.llm.shared import written

#: Edges that a task contracts at a time.
BLOCK_EDGES = 1 << 17


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a block of edges the nodes that reach a smaller one, and the least that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components: of each block that a task reads, one from each node to the least that it reaches there. So no
    node has more smaller neighbours than there are blocks."""
    kind = edges.schema["u"].dataType
    schema = T.StructType([T.StructField("u", kind), T.StructField("v", kind)])

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        found = least_reached(*(table[c].to_numpy() for c in schema.names))
        return pa.RecordBatch.from_arrays([pa.array(x, type=table.schema.field(0).type) for x in found], names=schema.names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK_EDGES:
                yield block(held)
                held, size = [], 0
        if size:
            yield block(held)

    of = edges.select("u", "v").filter(F.col("u") != F.col("v")).mapInArrow(run, schema)
    return of.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours, of which contracted edges leave few, move to the least of these."""
    around = edges.groupBy("u").agg(F.collect_set("v").alias("of")).select("u", "of", F.array_min("of").alias("m"))
    return around.select(F.explode(F.array_append(F.array_remove("of", F.col("m")), F.col("u"))).alias("u"), F.col("m").alias("v"))


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node leads to one node alone, which leads no further."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast(edges.schema["v"].dataType).alias("to")))
    seen = ends.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.count("to").alias("up"), F.count(F.lit(1)).alias("n"))
    return seen.filter((F.col("low") != F.col("high")) | (F.col("up") > 0) & (F.col("n") > F.col("up"))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of undirected edges (u, v): the smallest node it can reach. Nodes without an edge to another one are not in it.

    Tasks contract the edges they read before each round, so that rounds are few and a node moves in few of them. Every round writes
    its edges, at most as many as there were, to the shared folder. Rounds grow with the logarithm of the number of
    nodes, and end once all edges are stars. Loops and repeated edges do no harm.
    """
    now = written(contracted(edges), "edges")
    while not _all_stars(now):
        now = written(_small_star(_large_star(contracted(now))), "edges")
    now = now.distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
