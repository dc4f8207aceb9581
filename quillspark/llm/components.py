"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; the component is its smallest node.

    A large star links a node's larger neighbours to the least of its neighbourhood, a small star its
    smaller ones; both keep the components and end as stars after a number of rounds that grows with
    the logarithm of a path's length. Each round is written to the shared folder. No edges give no rows.
    """
    edges = scratch.write(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        if _settled(edges):
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        large = _star(both, larger=True)
        edges = scratch.write(_star(large.select(F.col("b").alias("u"), F.col("a").alias("v")), larger=False))
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)


def _settled(edges: DataFrame) -> bool:
    """Whether all distinct edges (smaller, larger) are stars: no larger end has a second edge."""
    ends = edges.select(F.col("a").alias("u"), F.lit(0).alias("up")).union(edges.select("b", F.lit(1)))
    nodes = ends.groupBy("u").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return nodes.agg(F.count_if((F.col("up") > 0) & (F.col("n") > 1))).first()[0] == 0


def _star(directed: DataFrame, larger: bool) -> DataFrame:
    """Edges (smaller, larger); ``directed`` holds u's neighbours v."""
    least = directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = directed.join(least, "u")
    if larger:
        out = moved.filter("v > u").select("m", F.col("v").alias("b"))
    else:
        out = moved.filter("v < u").select("m", F.col("v").alias("b")).union(least.select("m", F.col("u").alias("b")))
    return out.filter("m <> b").select(F.col("m").alias("a"), "b").distinct()
