"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component), the least node reachable, for nodes of links (a, b).

    Large-star and small-star steps in turn: every node tells its larger
    neighbours, then its smaller ones, of the least it knows. Trees shrink to
    stars in about log(n) rounds. Least values come from partial aggregates, and
    the join with a node's links can be split where it has many. Every round is
    written to the shared folder, so it neither grows the lineage nor depends on
    the executors that made it. Links of a node to itself keep it as a node.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    alone = edges.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    edges = cut(edges.where("u <> v"), "edges")
    before = None
    for _ in range(max_rounds):
        edges = cut(_small_star(_large_star(edges)), "edges")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if after == before:
            stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            known = stars.unionByName(roots)
            return known.unionByName(alone.join(known, "node", "left_anti"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the node's least neighbour, itself included."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
    return larger.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    smaller = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return own.unionByName(smaller).distinct()
