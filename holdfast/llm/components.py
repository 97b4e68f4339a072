"""Connected components by alternating large-star and small-star steps, each a grouping and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from holdfast.llm.tables import store


def _large(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest of itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("least").alias("a"), "b").filter("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the smallest of them; edges are (smaller, larger)."""
    least = edges.groupBy("b").agg(F.min("a").alias("least"))
    moved = edges.join(least, "b").select(F.col("least"), F.explode(F.array("a", "b")).alias("b"))
    return moved.filter("least != b").select(F.col("least").alias("a"), "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in a link (a, b); the component is its smallest node."""
    edges = store(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    mark = None
    while True:
        # Decided when all edges lead to a root: no node is both above and below another.
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
        edges = store(_small(_large(edges)), "edges")
    pairs = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return pairs.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
