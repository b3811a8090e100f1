"""Connected components of links by alternating large-star and small-star contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node's larger neighbours go to its smallest one. Small: its smaller ones, and the node itself, do.

    A node of many links is a hot key of a join only, which adaptive execution splits; minima are combined before the shuffle."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    near = both.join(least, both["a"] == least["node"])
    if large:
        return near.where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    # a chain a > b > m becomes (b, m) and (a, m)
    return near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of links(a, b). Nodes of any ordered type; no nulls."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    told = None
    for _ in range(most):
        edges = materialize(_stars(_stars(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == told:
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        told = now
    raise RuntimeError(f"links have not settled after {most} rounds")
