"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """large: joins each node's larger neighbours to its smallest neighbour (or itself); small: joins each node and
    its smaller neighbours to the smallest of them. Neither changes the components."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))  # a: the node, b: its neighbour
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = near.where("b > a").join(least, "a").select(F.col("b").alias("b"), F.col("m").alias("a"))
    else:
        near = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))  # a > b
        least = near.groupBy("a").agg(F.min("b").alias("m"))
        out = near.join(least, "a").select("b", F.col("m").alias("a")).where("a <> b").unionByName(least.select(F.col("a").alias("b"), F.col("m").alias("a")))
    return out.select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge in edges (a, b: long, a < b); component: its smallest node.
    A node of very many neighbours is met by aggregates, which combine before the shuffle, and joins, which Spark splits."""
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    own = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    before = mark(own)
    while before[0]:
        own = written(_stars(_stars(own, True), False), "edges")
        if (now := mark(own)) == before:
            break
        before = now
    return own.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(own.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
