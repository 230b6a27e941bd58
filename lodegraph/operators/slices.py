"""Slices of a graph: small sets of nodes around seeds, by groups and by components, each set once.

A slice is named by (enumerator, primary). Sets grow hop by hop and leave as soon as they pass the bound, so a hub is never expanded and no set is gathered: sizes are counts,
and equal sets are found by fingerprints that don't depend on order (count, sum and exclusive-or of two hashes of the members).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.operators.components import connected_components
from lodegraph.runtime import written

LEAST, MOST = 4, 80
_SPEC = ["enumerator", "primary"]


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct rows (node, other) of both directions, without self-loops."""
    ends = edges.where("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("other"))
    return ends.union(ends.select("other", "node")).distinct()


def top_hubs(edges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The `n` nodes of most distinct neighbours; ties go to the lesser id."""
    degree = neighbours(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    joined = nodes.select(F.col("node_id").alias("node")).join(degree, "node", "left")
    return joined.orderBy(F.coalesce("degree", F.lit(0)).desc(), "node").limit(n).select("node")


def lesser_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (primary, node) of all components but the largest; a component is named by its least node, and of equally large ones the least named counts as the largest."""
    found = connected_components(edges, "src", "dst")
    members = written(nodes.select(F.col("node_id").alias("node")).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("primary")))
    giant = members.groupBy("primary").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "primary").limit(1)
    return members.join(giant, "primary", "left_anti").select("primary", "node")


def grown(seeds: DataFrame, edges: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(members, sizes over the bound) of neighbourhoods of seeds (enumerator, primary, node, hops).

    A set with a frontier node of `most` neighbours or more passes the bound without being expanded.
    """
    links = written(neighbours(edges))
    degree = written(links.groupBy("node").agg(F.count(F.lit(1)).alias("degree")))
    hops = seeds.agg(F.max("hops")).first()[0] or 0
    members = written(seeds.select(*_SPEC, "node", "hops").distinct())
    front, over = members, None
    for hop in range(1, hops + 1):
        active = front.where(F.col("hops") >= hop).join(degree, "node")
        wide = written(active.where(F.col("degree") >= most).select(*_SPEC).distinct())
        moved = active.join(wide, _SPEC, "left_anti").join(links, "node").select(*_SPEC, F.col("other").alias("node"), "hops").distinct()
        added = written(moved.join(members, [*_SPEC, "node"], "left_anti"))
        whole = members.union(added)
        large = whole.groupBy(*_SPEC).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*_SPEC)
        lost = written(wide.union(large).distinct())
        over = lost if over is None else over.union(lost)
        members = written(whole.join(lost, _SPEC, "left_anti"))
        front = added.join(lost, _SPEC, "left_anti")
    none = members.select(*_SPEC).limit(0)
    return members.select(*_SPEC, "node"), (over if over is not None else none)


def enumerated(seeds: DataFrame, groups: DataFrame, edges: DataFrame, least: int = LEAST, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(slices, members): rows (enumerator, primary, n_members, disposition) of every candidate, and rows (enumerator, primary, node) of those that are kept.

    seeds: see `grown`; groups: (enumerator, primary, node). The disposition is `slice`, `over_projection_bound` (n_members is null where growth was cut short),
    `below_minimum_members` or `duplicate_member_set`; of equal sets the first by enumerator and primary stays.
    """
    near, over = grown(seeds, edges, most)
    sized = groups.select(*_SPEC, "node").distinct()
    counted = sized.groupBy(*_SPEC).agg(F.count(F.lit(1)).alias("n"))
    small = sized.join(counted.where(F.col("n") <= most).select(*_SPEC), _SPEC, "left_semi")
    members = written(near.union(small))
    marks = members.groupBy(*_SPEC).agg(F.count(F.lit(1)).alias("n_members"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("_sum"), F.bit_xor(F.xxhash64(F.lit(1), F.col("node"))).alias("_xor"))
    same = Window.partitionBy("n_members", "_sum", "_xor", F.col("n_members") >= least)
    ranked = marks.withColumn("_first", F.min(F.struct(*_SPEC)).over(same))
    disposition = F.when(F.col("n_members") < least, "below_minimum_members").when(F.struct(*_SPEC) != F.col("_first"), "duplicate_member_set").otherwise("slice")
    judged = written(ranked.select(*_SPEC, "n_members", disposition.alias("disposition")))
    large = counted.where(F.col("n") > most).select(*_SPEC, "n").union(over.select(*_SPEC, F.lit(None).cast("long")))
    slices = judged.union(large.select(*_SPEC, "n", F.lit("over_projection_bound")))
    return slices, members.join(judged.where("disposition = 'slice'"), _SPEC, "left_semi")
