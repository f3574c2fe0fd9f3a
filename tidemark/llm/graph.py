"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import store

MAX_ROUNDS = 64  # rounds grow with the logarithm of the graph: enough for any that can be stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one parent, or is one: then the stars are the components."""
    ends = edges.select("u", F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    ends = ends.groupBy("u").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return not ends.filter("child > 1 or child = 1 and root = 1").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v); component is the least node reachable.

    Each round is written to the shared folder. Minima are taken by partial aggregates and joined
    back, so a node with very many neighbours is never gathered. No edges: no rows.
    """
    now = store.table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        nxt = store.table(_small_star(_large_star(now)), "star")
        store.drop_table(now)
        now = nxt
        if _are_stars(now):
            break
    else:
        raise RuntimeError(f"components are not complete after {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
