"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.runtime import checkpoint


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """One contraction: point each neighbour of a node (`both`: larger ones; else smaller ones and the node) at the least of them.

    The least neighbour is a map-side combined aggregate, so a node with very many edges isn't
    gathered; the join back splits such a node's rows.
    """
    pairs = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if both else edges
    least = pairs.groupBy("src").agg(F.min("dst").alias("least"))
    if both:
        least = least.select(F.col("src").alias("hub"), F.least("src", "least").alias("least"))
        joined = pairs.where("dst > src").join(least, F.col("src") == F.col("hub"))
        return joined.select(F.col("dst").alias("src"), F.col("least").alias("dst")).where("src <> dst")
    least = least.select(F.col("src").alias("hub"), "least")
    moved = edges.join(least, F.col("src") == F.col("hub")).select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.union(least.select("hub", "least")).where("src <> dst").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one lesser neighbour, which itself has none: then it is the component's least node."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("dst", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.where("up > 1 OR (up > 0 AND down > 0)").head(1)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of an edge; the component is its least node.

    Edges with a null end and self-loops join nothing; a node that has only such edges isn't
    listed. Parallel edges and both directions are the same edge.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    current = checkpoint(ends.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct())
    for _ in range(max_rounds):
        if _are_stars(current):
            break
        current = checkpoint(_stars(_stars(current, True), False))
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return current.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(current.select("dst", "dst").distinct())
