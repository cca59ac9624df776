"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import stage


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected graph with the smallest node of its component.

    edges: columns a, b (long, no nulls; loops and repeats allowed). Returns node, component
    for the nodes that have an edge to another node; isolated nodes have no row.

    Every round links each node's larger neighbours to its smallest neighbour (large star), then
    its smaller ones (small star). A hub's edges are never gathered: its minimum is a partial
    aggregate, and the join back is one that skew handling can split. The edge table is written to
    the shared folder in each round, so lost executors cost one round at most. No edges: no rows.
    """
    current = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = _mark(current)
    for _ in range(max_rounds if mark[0] else 0):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        current = stage(small, "stars")
        found = _mark(current)
        if found == mark:
            break
        mark = found
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
