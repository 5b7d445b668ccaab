"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.cluster import cut


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, root): root is the least node of the component; a row for each node in some edge.

    Each round sends every node's neighbours to its least neighbour, until all
    components are stars; the edge table stays linear in the nodes, is cut to the shared folder each round
    and never comes to the driver.  The result is in the shared folder.  Loops, repeated edges and nulls in either
    end are dropped.  No edges: no rows.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.union(edges.select("b", "a"))
        # Kept apart from the join, so that adaptive execution can split a node of very many neighbours there.
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") < F.col("a")).alias("up"), F.count(F.lit(1)).alias("n")))
        # In stars a node has one edge to a node that has none itself; then the least neighbour is the root.
        if not least.where("up > 1 or up = 1 and n > 1").count():
            return least.select(F.col("a").alias("node"), F.col("m").alias("root"))
        # Large star: the larger neighbours of a node go to the least of its neighbours and itself.
        large = both.where("b > a").join(least.select("a", "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node's smaller neighbours and itself go to the least of them.
        large = cut(large)
        small = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.join(small, "a").select(F.col("b").alias("x"), "m").union(small.select(F.col("a").alias("x"), "m"))
        edges = cut(moved.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
