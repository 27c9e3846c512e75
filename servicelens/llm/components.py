"""Connected components of an edge table, without any task holding a component.

Each round every node points to its smallest neighbour if that is smaller than itself. The pointers
form trees; they are shortened by doubling until each node points to its root, then the edges are
rewritten to roots and only those between different roots stay. A round leaves local minima only, so
the table shrinks geometrically. Tables of a round are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servicelens.llm.common import stored


def _jumped(parents: DataFrame, through: DataFrame) -> DataFrame:
    step = through.select(F.col("node").alias("__at"), F.col("parent").alias("__next"))
    return parents.join(step, F.col("parent") == F.col("__at"), "left").select(
        "node", F.coalesce("__next", "parent").alias("parent")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); component is the smallest node it reaches.

    Loops, repeated edges and edges in both directions do no harm; an empty table gives an empty result.
    """
    edges = stored(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        parents = stored(parents.select("node", F.least("node", "parent").alias("parent")), "parents")
        while True:
            jumped = stored(_jumped(parents, parents), "parents")
            moved = jumped.join(
                parents.withColumnRenamed("parent", "__old"), "node"
            ).where(F.col("parent") != F.col("__old"))
            parents = jumped
            if moved.isEmpty():
                break
        labels = parents if labels is None else stored(
            _jumped(labels, parents).unionByName(parents.join(labels, "node", "left_anti")), "labels"
        )
        ends = edges.join(parents.select(F.col("node").alias("a"), F.col("parent").alias("__a")), "a")
        ends = ends.join(parents.select(F.col("node").alias("b"), F.col("parent").alias("__b")), "b")
        ends = ends.where(F.col("__a") != F.col("__b"))
        edges = stored(ends.select(F.col("__a").alias("a"), F.col("__b").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.withColumnRenamed("parent", "component")
