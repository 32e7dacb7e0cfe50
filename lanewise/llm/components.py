"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.stages import staged


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of all nodes with an edge; edges are ``a, b`` of a sortable type.

    Every round each node points at its smallest neighbour below it, pointers
    are followed to their ends, and the edges between the ends are what is
    left.  A round at least halves the nodes that still have edges.  Nodes,
    pointers and edges stay in tables; the driver sees only whether edges are
    left.  Joins are of plain tables, so adaptive execution splits the many
    edges of a hub.  Self-loops, repeated edges and edges with a null end carry
    no link; an empty table has no components.
    """
    edges = edges.where("a is not null and b is not null and a != b")
    edges = staged(edges.select("a", "b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        lowest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        parents = staged(
            lowest.select("node", F.least("node", "near").alias("root")), "parents"
        )
        parents = followed(parents)
        if labels is None:
            labels = parents
        else:
            moved = parents.select(F.col("node").alias("root"), F.col("root").alias("top"))
            labels = labels.join(moved, "root", "left")
            labels = staged(
                labels.select("node", F.coalesce("top", "root").alias("root")), "labels"
            )
        ends = parents.select(F.col("node").alias("a"), F.col("root").alias("u"))
        others = parents.select(F.col("node").alias("b"), F.col("root").alias("v"))
        left = edges.join(ends, "a").join(others, "b").where("u != v")
        left = left.select(
            F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")
        ).distinct()
        edges = staged(left, "edges")
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def followed(parents: DataFrame) -> DataFrame:
    """Let every node point at the end of its chain of pointers."""
    while True:
        above = parents.select(F.col("node").alias("root"), F.col("root").alias("top"))
        parents = staged(
            parents.join(above, "root").select(
                "node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")
            ),
            "parents",
        )
        if parents.where("moved").isEmpty():
            return parents.select("node", "root")
