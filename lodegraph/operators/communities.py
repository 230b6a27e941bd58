"""Communities and centrality by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.operators.graph import reach
from lodegraph.runtime import checkpoint


def label_propagation(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Rows (node, label, settled): synchronous label propagation, ties to the least label; settled says whether it ended by itself.

    A node keeps its own label as one vote, which stops two-colourings from swapping for ever.
    Votes are counted per (node, label) with map-side combining before the best is taken.
    """
    pairs = edges.select("src", "dst").where("src <> dst")
    links = checkpoint(pairs.union(pairs.select("dst", "src")).distinct())
    labels = links.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = links.join(labels, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "label").union(labels.select("node", "label"))
        counted = votes.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
        best = counted.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best")).select("node", F.col("best.label").alias("label"))
        after = checkpoint(best)
        changed = after.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").head(1)
        labels = after
        if not changed:
            return labels.withColumn("settled", F.lit(True))
    return labels.withColumn("settled", F.lit(False))


def closeness(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """Per source: nodes reached within `depth` undirected hops, and the harmonic sum of their distances."""
    found = reach(edges, sources, depth, directed=False).where("depth > 0")
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("reached"), F.round(F.sum(1 / F.col("depth")), 6).alias("harmonic"))


def bounded_descent(pairs: DataFrame, nodes: DataFrame, roots: DataFrame, kind_cap: int, depth: int) -> DataFrame:
    """Rows (root, node, kind, depth, withheld): children level by level, the first `kind_cap` per parent and kind by id.

    `withheld` is what a parent had more of the kind; it is reported on the kind's first child.
    """
    kinds = nodes.select(F.col("node_id").alias("child"), "kind")
    front = roots.select(F.col("node_id").alias("root"), F.col("node_id").alias("node"))
    found = None
    for level in range(1, depth + 1):
        children = front.join(pairs, F.col("node") == F.col("parent")).join(kinds, "child")
        window = Window.partitionBy("root", "parent", "kind")
        ranked = children.withColumn("rank", F.row_number().over(window.orderBy("child"))).withColumn("total", F.count(F.lit(1)).over(window)).where(F.col("rank") <= kind_cap)
        kept = checkpoint(ranked.select("root", F.col("child").alias("node"), "kind", F.lit(level).alias("depth"), F.when(F.col("rank") == 1, F.greatest(F.col("total") - kind_cap, F.lit(0))).otherwise(0).alias("withheld")))
        found = kept if found is None else found.union(kept)
        front = kept.select("root", "node")
        if kept.isEmpty():
            break
    return found
