"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.common import stage_table


def _roots(parents: DataFrame) -> DataFrame:
    """(node, parent) with every parent a root: parents are smaller than their nodes, so doubling the paths ends."""
    while True:
        up = parents.select(F.col("node").alias("mid"), F.col("parent").alias("top"))
        jumped = stage_table(
            parents.join(up, F.col("parent") == F.col("mid"), "left").select("node", F.coalesce("top", "parent").alias("parent"), F.col("top").isNotNull().alias("moved")),
            "cc-jump",
        )
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), both long: root is the smallest node of its component.

    In each round a node hooks to its smallest neighbour if that is smaller than itself, trees are flattened by path
    doubling, and the edges between the roots make up the next round's graph. The number of roots that have edges at
    least halves, so rounds grow with the logarithm of the nodes. Everything is written to the shared folder between rounds.
    """
    labels = None
    edges = stage_table(edges.select("a", "b").where("a <> b").distinct(), "cc-edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        nearest = stage_table(nearest.withColumn("parent", F.least("node", "parent")), "cc-hook")
        roots = _roots(nearest.where("parent < node"))
        if labels is None:
            labels = nearest.select("node").join(roots, "node", "left").select("node", F.coalesce("parent", "node").alias("root"))
        else:
            labels = labels.join(roots.select(F.col("node").alias("root"), "parent"), "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
        labels = stage_table(labels, "cc-labels")
        ra, rb = roots.select(F.col("node").alias("a"), F.col("parent").alias("ra")), roots.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        moved = edges.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        edges = stage_table(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
