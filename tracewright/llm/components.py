"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` (longs); ``root`` is one node of
    its component.

    In every round each node that has a smaller neighbour takes the smallest as its
    parent, parents are followed one step further, and the edges are rewritten to
    the parents; edges inside one node vanish.  It ends when no edge is left.  Groups
    are reduced by minimum only, so a node with very many edges costs no memory.  Nodes
    should be hashes: along a chain of random names a round leaves a part of the nodes,
    along one of ascending names it takes off only two."""
    edges = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).distinct())
    roots = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")))
    edges = cut(edges.where("a <> b"))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = cut(both.groupBy(F.col("a").alias("child")).agg(F.min("b").alias("parent")).where("parent < child"))
        further = least.select(F.col("child").alias("parent"), F.col("parent").alias("next"))
        step = cut(least.join(further, "parent", "left").select("child", F.coalesce("next", "parent").alias("parent")))
        roots = cut(
            roots.join(step, roots["root"] == step["child"], "left").select("node", F.coalesce("parent", "root").alias("root"))
        )
        for end in ("a", "b"):
            edges = edges.join(step, edges[end] == step["child"], "left").withColumn(end, F.coalesce("parent", end)).select("a", "b")
        edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return roots
