"""Connected components of a graph given as edges, in Spark, by repeated contraction.

Every round each node points at its least neighbour (or itself), pointers are followed twice, and the graph shrinks to
the nodes pointed at. All groupings are sums and minima that Spark combines before its shuffle, and the joins have a
unique side, so that adaptive execution can split the side of a node with very many edges. Each round's tables are
written below the shared folder, and removed when the next round's are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, free


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns a and b; returns (node, root), one row for each node on an edge, root the same
    throughout a component. Loops and repeated edges are allowed; without edges the result is empty."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = cut(both.where("a <> b").distinct(), "cc-links")
    labels = None
    while not links.isEmpty():
        point = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        point = cut(point, "cc-point")
        hop = point.select(F.col("a").alias("p"), F.col("p").alias("q"))
        jump = cut(point.join(hop, "p").select("a", F.col("q").alias("root")), "cc-jump")
        old, held = links, labels
        if labels is None:
            labels = jump.select(F.col("a").alias("node"), "root")
        else:
            moved = jump.select(F.col("a").alias("root"), F.col("root").alias("to"))
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = cut(labels, "cc-labels")
        left = jump.select("a", F.col("root").alias("x"))
        right = jump.select(F.col("a").alias("b"), F.col("root").alias("y"))
        links = links.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        links = cut(links, "cc-links")
        free(old, held, point, jump)
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
