"""Queries over a tree of variables, kept as a table (path, host, name, idx, kind, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.scalars import path_parts


def search(tree: DataFrame, pattern: str) -> DataFrame:
    """Leaves whose path matches a regular expression."""
    return tree.filter(F.col("path").rlike(pattern))


def get(tree: DataFrame, path: str) -> DataFrame:
    return tree.filter(F.col("path") == path).select("path", "value")


def assign(tree: DataFrame, settings: DataFrame) -> DataFrame:
    """Values from ``settings`` (name, idx, value) into configuration leaves: a setting without an index reaches all instances of
    the name, one with an index that instance; where both apply the indexed one wins. Returns the leaves that get a value, with
    it in ``new_value``; names that no leaf has drop out."""
    on = (tree["name"] == settings["name"]) & (settings["idx"].isNull() | settings["idx"].eqNullSafe(tree["idx"]))
    hits = tree.join(settings.select("name", "idx", F.col("value").alias("new_value")), on).select(*[tree[c] for c in tree.columns], settings["idx"].alias("_by"), "new_value")
    rank = F.row_number().over(Window.partitionBy("path", "s_suppkey").orderBy(F.col("_by").isNull(), "new_value"))
    return hits.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_by")


def unknown_settings(tree: DataFrame, settings: DataFrame) -> DataFrame:
    """Settings whose name no leaf has."""
    return settings.join(tree.select("name").distinct(), "name", "left_anti")


def verify(expected: DataFrame, got: DataFrame, *, key: str = "address") -> DataFrame:
    """Registers (address, value, mask) whose bits under the mask differ from those read (address, value)."""
    a, b = expected.select(key, F.col("value").alias("expected"), "mask"), got.select(key, F.col("value").alias("got"))
    return a.join(b, key).filter(F.col("expected").bitwiseAND(F.col("mask")) != F.col("got").bitwiseAND(F.col("mask")))


def linked(tree: DataFrame, links: DataFrame) -> DataFrame:
    """Values that variables take from others: links (path, target)."""
    return links.join(tree.select(F.col("path").alias("target"), "value", "s_suppkey"), "target").select("path", "target", "value", "s_suppkey")


def enabled(tree: DataFrame, off: DataFrame) -> DataFrame:
    """Leaves of subtrees that are not switched off: ``off`` holds hosts."""
    return tree.join(off, "host", "left_anti")


def levels(tree: DataFrame) -> DataFrame:
    """Each leaf's path taken apart: (path, depth, name, idx)."""
    return tree.select("path", "s_suppkey", F.posexplode(path_parts(F.col("path"))).alias("depth", "p")).select("path", "s_suppkey", "depth", F.col("p.name").alias("name"), F.col("p.idx").alias("idx"))
