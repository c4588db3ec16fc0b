"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.workspace import forget, saved


def _minima(edges: DataFrame) -> DataFrame:
    """The least neighbour of each node. A minimum is combined before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minima(both).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u > v")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = _minima(edges)
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u > v").union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame):
    return edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
    ).first()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that a link (u, v) of longs names.

    root is the least node of the component. Every round is a few joins on single nodes,
    whose other side has one row per node, so Spark can split a node with many links; the
    links stay in tables of the shared folder. Links of a node with itself, or with null,
    count for nothing.
    """
    edges = saved(
        links.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    before = None
    while (now := _state(edges)) != before:
        before, last = now, edges
        edges = saved(_small_star(_large_star(edges)), "links")
        forget(last)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
