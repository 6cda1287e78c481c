"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.common import forget, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. ``edges``: (u, v) with u > v, no repeats.

    Large star: every neighbour above a node moves to the node's smallest neighbour (or itself). Small star: a node and
    its smaller neighbours move to the smallest of them. Minima are map-side combined; no neighbour list is collected.
    """
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    moved = both.join(least, "u")
    if large:
        moved = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; a component is named by its smallest node.

    ``edges`` has two columns of ids; direction, repeats and loops do not matter. Every round is written to the shared
    folder, so lineage stays short and lost executors cost one round.
    """
    a, b = (F.col(c) for c in edges.columns)
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    seen = _state(now)
    while seen[0]:
        large = written(_star(now, large=True), "edges-large")
        small = written(_star(large, large=False), "edges-small")
        forget(now, large)
        now, before, seen = small, seen, _state(small)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
