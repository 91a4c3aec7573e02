"""Connected components of an edge table by repeated contraction.

Every round, each node points to its smallest neighbour (or itself), pointers
are shortened until they end at roots, and the edges are rewritten between
roots; a round at least halves the nodes that still have edges. Only
aggregates with map-side combine and equi-joins are used, so a node with a
third of all edges is neither collected nor sent to one task whole. Every
round is written as a table in the shared checkpoint folder, which cuts the
lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmetrics.session import materialize


def _shortened(parents: DataFrame) -> DataFrame:
    """Follow the pointers (node, parent) until every parent is a root."""
    while True:
        up = parents.where("node <> parent").select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        step = materialize(parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")), "pointers")
        parents = step.select("node", "parent")
        if step.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b)."""
    rest = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("parent"))
        roots = _shortened(materialize(nearest, "pointers"))
        if labels is None:
            labels = roots.withColumnRenamed("parent", "component")
        else:
            above = roots.select(F.col("node").alias("component"), F.col("parent").alias("higher"))
            labels = materialize(labels.join(above, "component", "left").select("node", F.coalesce("higher", "component").alias("component")), "labels")
        at = lambda end: roots.select(F.col("node").alias(end), F.col("parent").alias(f"root_{end}"))
        moved = rest.join(at("a"), "a").join(at("b"), "b").where("root_a <> root_b")
        rest = materialize(moved.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "edges")
    return labels if labels is not None else rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
