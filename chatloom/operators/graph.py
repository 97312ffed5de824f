"""Paths of message graphs: nodes that name their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written


def paths(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """conv_id, node, depth: every node from each start (conv_id, node) up to its root; a start is at depth 0.

    nodes: conv_id, node, parent. Ancestors are found by doubling: a round knows those 2^k steps up,
    joins them with themselves and with the path so far, and writes both, so a chain of n nodes takes
    about log2(n) rounds. A parent that is not among the nodes ends the path; a cycle ends where it
    would repeat a node. Rows without conv_id or node take no part; of nodes given twice the larger
    parent counts.
    """
    known = nodes.where("conv_id is not null and node is not null").groupBy("conv_id", "node").agg(F.max("parent").alias("parent"))
    known = written(known, "nodes")
    up = known.join(known.select("conv_id", F.col("node").alias("parent")), ["conv_id", "parent"], "left_semi").select("conv_id", "node", "parent")
    path = written(starts.select("conv_id", "node").distinct().join(known.select("conv_id", "node"), ["conv_id", "node"], "left_semi").select("conv_id", "node", F.lit(0).alias("depth")), "path")
    step, count = 1, path.count()
    while count:
        up = written(up, "up")
        further = path.join(up, ["conv_id", "node"]).select("conv_id", F.col("parent").alias("node"), (F.col("depth") + step).alias("depth"))
        path = written(path.union(further).groupBy("conv_id", "node").agg(F.min("depth").alias("depth")), "path")
        before, count = count, path.count()
        if count == before:
            break
        twice = up.select("conv_id", F.col("node").alias("parent"), F.col("parent").alias("above"))
        up = up.join(twice, ["conv_id", "parent"]).select("conv_id", "node", F.col("above").alias("parent"))
        step *= 2
    return path
