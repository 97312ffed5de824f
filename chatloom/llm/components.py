"""Connected components of a link table, as rounds of written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

LINKS_PER_TASK = 1_000_000


def connected_components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the component's smallest node.

    Alternates large-star and small-star steps, which need about log(nodes) rounds. Hubs are safe:
    a step aggregates a minimum per node, then joins it back, and gathers no neighbour list.
    """
    edges = work.save(_directed(links), f"{name}-0")
    few = max(8, -(-edges.count() // LINKS_PER_TASK))  # a round never makes links; tasks for as many as there are
    k, before = 0, None
    while True:
        large = _star(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), keep_larger=True)
        down = large.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        k += 1
        edges = work.save(_directed(_star(down, keep_larger=False)).coalesce(few), f"{name}-{k}")
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if k > 1:
            work.drop(f"{name}-{k - 1}")
        if (state.n, state.x) == before or not state.n:
            break
        before = (state.n, state.x)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _directed(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _star(arcs: DataFrame, keep_larger: bool) -> DataFrame:
    """Link u's neighbours v (all below u, or those above it) to the smallest of u and its neighbours."""
    low = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    joined = arcs.join(low, "u")
    if keep_larger:
        return joined.where("v > u").select(F.col("low").alias("a"), F.col("v").alias("b"))
    return joined.select(F.col("low").alias("a"), F.col("v").alias("b")).union(low.select(F.col("low").alias("a"), F.col("u").alias("b")))
