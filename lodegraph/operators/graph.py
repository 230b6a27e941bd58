"""Graph operators over nodes (node_id, kind, label, ...) and edges (edge_id, relation, role, parent_end, src, dst).

Every operator is a join or an aggregate over whole tables; traversals advance one level at a
time over all sources together, carry only (source, node, depth), and cut lineage each level
through the shared folder.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.runtime import checkpoint, dealt, written


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """Each edge from each end: (node, other, direction, relation, role, parent_end, edge_id, and the columns `more`); a self-loop counts as `out` once."""
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("direction")),
        F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("direction")),
    )
    kept = F.when(F.col("src") == F.col("dst"), F.slice(ends, 1, 1)).otherwise(ends)
    return edges.select("edge_id", "relation", "role", "parent_end", *more, F.explode(kept).alias("e")).select("e.*", "relation", "role", "parent_end", "edge_id", *more)


def one_way(edges: DataFrame, direction: str) -> DataFrame:
    """The rows (node, other, relation) of `both_ways` in one direction."""
    if direction == "out":
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "relation")
    return edges.where(~_looped()).select(F.col("dst").alias("node"), F.col("src").alias("other"), "relation")


def neighbour_counts(edges: DataFrame, tasks: int = 1) -> DataFrame:
    """Rows (node, n, n_distinct): a node's edges and its distinct other ends; edges are summed by pair in tasks of bounded size, so no hub is gathered."""
    pairs = dealt(both_ways(edges).select("node", "other"), tasks, "node", "other").groupBy("node", "other").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("node").agg(F.sum("n").alias("n"), F.count("other").alias("n_distinct"))


def structural_pairs(edges: DataFrame) -> DataFrame:
    """Structural edges oriented by their registry end: (parent, child), distinct."""
    down = F.col("parent_end") == "from"
    return edges.where(F.col("role") == "structural").select(F.when(down, F.col("src")).otherwise(F.col("dst")).alias("parent"), F.when(down, F.col("dst")).otherwise(F.col("src")).alias("child")).distinct()


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by node kind and by relation: (family, name, n)."""
    by_kind = nodes.groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("family"), "name", "n")
    return by_kind.union(edges.groupBy(F.col("relation").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("family"), "name", "n"))


def _with_ends(edges: DataFrame, nodes: DataFrame, columns: tuple[str, ...], tasks: int) -> DataFrame:
    """`edges` with `_src` and `_dst`, lists of the `columns` of the nodes at their ends (null where there is none), dealt by `dst`.

    Each edge moves twice, not once from each end, and the edges into a node lie in one task afterwards.
    """
    about = nodes.groupBy("node_id").agg(F.collect_list(F.struct(*columns)).alias("_about"))
    for end in ("src", "dst"):
        edges = dealt(edges, tasks, end).join(about.select(F.col("node_id").alias(end), F.col("_about").alias(f"_{end}")), end, "left")
    return edges


def _looped() -> Column:
    return F.coalesce(F.col("src") == F.col("dst"), F.lit(False))


def bundles(nodes: DataFrame, edges: DataFrame, tasks: int = 1) -> DataFrame:
    """Per node, edge counts by role, relation, direction and kind of the other end; never truncated. Kinds are met in `tasks` tasks."""
    ends = _with_ends(edges.select("src", "dst", "role", "relation"), nodes, ("kind",), tasks)
    side = lambda rows, direction, node, about: rows.select(F.col(node).alias("node"), "role", "relation", F.lit(direction).alias("direction"), F.explode(f"{about}.kind").alias("other_kind")).groupBy("node", "role", "relation", "direction", "other_kind").agg(F.count(F.lit(1)).alias("n"))
    return side(ends, "out", "src", "_dst").union(side(ends.where(~_looped()), "in", "dst", "_src"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node: degree, structural_degree, structural_children; zero where there is no edge."""
    structural = F.col("role") == "structural"
    child = structural & (((F.col("parent_end") == "from") & (F.col("direction") == "out")) | ((F.col("parent_end") == "to") & (F.col("direction") == "in")))
    counted = both_ways(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.count_if(structural).alias("structural_degree"), F.count_if(child).alias("structural_children"))
    joined = nodes.select("node_id", "kind").join(counted, F.col("node_id") == F.col("node"), "left")
    return joined.select("node_id", "kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("degree", "structural_degree", "structural_children")])


def ranked_neighbours(nodes: DataFrame, edges: DataFrame, limit: int, tasks: int = 1) -> DataFrame:
    """Per node its first `limit` neighbours by role, child first, relation, kind, label, edge id, and whether there are more.

    Of the edges into a node only those that can be shown move on. An edge id that is spelled from the relation and the ends isn't moved at all.
    """
    spelled = F.concat_ws("|", "relation", "src", "dst")
    by_role = F.when(F.col("role") == "structural", 0).when(F.col("role") == "flow", 2).otherwise(4).alias("_role")
    own = F.when(~F.col("edge_id").eqNullSafe(spelled), F.struct("edge_id")).alias("_own")
    ends = _with_ends(edges.select("src", "dst", "relation", "parent_end", by_role, own), nodes, ("kind", "label"), tasks)

    def side(rows: DataFrame, direction: str, node: str, other: str, parent_end: str) -> DataFrame:
        place = F.col("_role") + F.when(F.col("parent_end") == parent_end, 0).otherwise(1)
        return rows.select(F.col(node).alias("node"), F.col(other).alias("other"), F.lit(direction).alias("direction"), "relation", place.alias("_place"), "_own", F.explode(f"_{other}").alias("_o")).select(
            "node", "other", "direction", "relation", "_place", "_own", F.col("_o.kind").alias("other_kind"), F.col("_o.label").alias("other_label")
        )

    out = F.col("direction") == "out"
    edge_id = F.when(F.col("_own").isNull(), F.concat_ws("|", F.col("relation"), F.when(out, F.col("node")).otherwise(F.col("other")), F.when(out, F.col("other")).otherwise(F.col("node")))).otherwise(F.col("_own.edge_id"))
    nth = F.row_number().over(Window.partitionBy("node").orderBy("_place", "relation", "other_kind", "other_label", edge_id))
    into = side(ends.where(~_looped()), "in", "dst", "src", "to").withColumn("rank", nth).where(F.col("rank") <= limit + 1).drop("rank")
    ranked = dealt(side(ends, "out", "src", "dst", "from").union(into), tasks, "node").withColumn("rank", nth)
    bounded = ranked.where(F.col("rank") <= limit + 1).withColumn("truncated", F.max("rank").over(Window.partitionBy("node")) > limit)
    return bounded.where(F.col("rank") <= limit).select("node", "rank", "relation", "direction", "other", "other_kind", "truncated")


def search(nodes: DataFrame, term: str, kinds: list[str] | None = None) -> DataFrame:
    """Nodes whose search text holds the lower-cased term; a blank term finds nothing."""
    wanted = term.strip().lower()
    found = nodes.where(F.col("search_text").contains(wanted) if wanted else F.lit(False))
    found = found.where(F.col("kind").isin(kinds)) if kinds else found
    return found.withColumn("exact", F.lower("label") == wanted)


def quota(found: DataFrame, limit: int, order: list[Column], by: str = "kind", each: int | None = None) -> DataFrame:
    """The first rows of each `by` value, at most max(3, ceil(limit / 4)) of them unless `each` says else, with what is withheld of it."""
    each = each or max(3, -(-limit // 4))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    counts = found.groupBy(F.col(by).alias("_by")).agg(F.greatest(F.count(F.lit(1)) - each, F.lit(0)).alias("withheld"))
    return ranked.where(F.col("rank") <= each).join(counts, F.col(by) == F.col("_by")).drop("_by")


def consumers(edges: DataFrame, relation: str) -> DataFrame:
    """Per target of a relation: how many edges publish to it and by how many distinct sources."""
    return edges.where(F.col("relation") == relation).groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src").alias("n_sources"))


def reach(edges: DataFrame, sources: DataFrame, depth: int | None, directed: bool = True) -> DataFrame:
    """Rows (source, node, depth) of every node within `depth` hops (None: at any distance), at its least depth; sources have column node_id."""
    step = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    step = (step if directed else step.union(step.select("b", "a"))).where("a <> b").distinct()
    found = checkpoint(sources.select(F.col("node_id").alias("source"), F.col("node_id").alias("node"), F.lit(0).alias("depth")).distinct())
    front = found
    for level in count(1) if depth is None else range(1, depth + 1):
        moved = front.join(step, F.col("node") == F.col("a")).select("source", F.col("b").alias("node")).distinct()
        front = checkpoint(moved.join(found, ["source", "node"], "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        found = found.union(front)
    return found


def two_step_counts(first: DataFrame, second: DataFrame, most: int = 4096) -> DataFrame:
    """Rows (source, n): how many distinct nodes each source reaches over `first` (source, via) and then `second` (via, node).

    The pairs of source and node are many times the rows, so none is shuffled: the sources of a `via` go as lists to each of its
    nodes, a node drops what its lists share, and the rest is counted by source before it leaves the task. Where a `via` has
    more than `most` sources, all are dealt into blocks by hash, which bounds the lists.
    """
    first = written(first.where("source IS NOT NULL AND via IS NOT NULL").distinct())
    widest = first.groupBy("via").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 1
    block = F.pmod(F.xxhash64("source"), F.lit(-(-widest // most)))
    lists = first.groupBy("via", block.alias("block")).agg(F.collect_list("source").alias("sources"))
    met = second.where("via IS NOT NULL").distinct().join(lists, "via").groupBy("node", "block").agg(F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"))
    return met.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def within_two(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (source, n): the other nodes within two undirected hops of each source that has any, as `reach` has them, without listing them.

    A source of one neighbour has as many as that neighbour has. For other sources, nodes of one neighbour are
    summed by the node they hang on; only nodes of several neighbours, which can be met twice, are counted by distinct pairs.
    """
    ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    step = written(ends.union(ends.select("b", "a")).distinct())
    degree = written(step.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.min("b").alias("only")))
    start = written(sources.select(F.col("node_id").alias("source")).distinct().join(degree, F.col("source") == F.col("node")).select("source", "degree", "only"))
    single = start.where("degree = 1").join(degree.select("node", F.col("degree").alias("n")), F.col("only") == F.col("node")).select("source", "n")
    met = written(start.where("degree > 1").select("source").join(step, F.col("source") == F.col("a")).select("source", F.col("b").alias("node")))
    hung = degree.where("degree = 1").groupBy(F.col("only").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    near = met.union(met.select("source", F.col("source").alias("node")).distinct())
    leaves = near.join(hung, "node").groupBy("source").agg(F.sum("n").alias("n"))
    inner = degree.where("degree > 1").select("node")
    inside = met.join(inner, "node", "left_semi").select("source", "node")
    far = inside.join(step.join(inner.withColumnRenamed("node", "b"), "b", "left_semi"), F.col("node") == F.col("a")).select("source", F.col("b").alias("node"))
    pairs = inside.union(far).where("source <> node").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return single.union(leaves.union(pairs).groupBy("source").agg(F.sum("n").alias("n")))


def descendants(edges: DataFrame) -> DataFrame:
    """Per parent, its distinct descendants over structural pairs, at any depth.

    Where no descendant has two parents, subtrees are disjoint, so counts are summed up level by level: a row per node, whatever the depth. Only
    parents above a node of several parents, and those on or below a cycle, are counted by their (source, node) pairs.
    """
    pairs = checkpoint(structural_pairs(edges).where("parent <> child"))
    shared = pairs.groupBy("child").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("child").alias("node"))
    tangled = above = checkpoint(shared)
    while not above.isEmpty():
        above = checkpoint(pairs.join(above, F.col("child") == F.col("node"), "left_semi").select(F.col("parent").alias("node")).distinct().join(tangled, "node", "left_anti"))
        tangled = tangled.union(above)
    tangled = checkpoint(tangled.join(pairs.select(F.col("parent").alias("node")).distinct(), "node", "left_semi"))
    plain = checkpoint(pairs.join(tangled, F.col("parent") == F.col("node"), "left_anti"))
    roots = plain.select(F.col("parent").alias("node")).distinct().join(plain.select(F.col("child").alias("node")), "node", "left_anti")
    levels = [checkpoint(roots)]
    while True:
        below = checkpoint(plain.join(levels[-1], F.col("parent") == F.col("node")).select(F.col("child").alias("node")))
        if below.isEmpty():
            break
        levels.append(below)
    counted, found = levels[-1].withColumn("n", F.lit(0).cast("long")), None
    for upper in reversed(levels[:-1]):
        sums = plain.join(counted, F.col("child") == F.col("node")).groupBy(F.col("parent").alias("node")).agg(F.sum(F.col("n") + 1).alias("n"))
        counted = checkpoint(upper.join(sums, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n")))
        found = counted if found is None else found.union(counted)
    simple = (found if found is not None else counted).where("n > 0").select(F.col("node").alias("node_id"), F.col("n").alias("descendants"))
    rest = pairs.select(F.col("parent").alias("node_id")).distinct().join(simple, "node_id", "left_anti")
    if rest.isEmpty():
        return simple
    step = pairs.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    walked = reach(step, rest, None).where("depth > 0 AND source <> node").groupBy(F.col("source").alias("node_id")).agg(F.count(F.lit(1)).alias("descendants"))
    return simple.union(walked)


def ancestry(edges: DataFrame, starts: DataFrame, depth: int = 12) -> DataFrame:
    """Rows (source, node, depth) of the containers of each start."""
    up = structural_pairs(edges).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return reach(up, starts, depth).where("depth > 0")


def one_sided(edges: DataFrame, relation: str, other_relation: str) -> DataFrame:
    """Targets of `relation` that `other_relation` never reaches."""
    held = edges.where(F.col("relation") == other_relation).select(F.col("dst").alias("node_id"))
    return edges.where(F.col("relation") == relation).select(F.col("dst").alias("node_id")).distinct().join(held, "node_id", "left_anti")


def coupling(nodes: DataFrame, edges: DataFrame, scope: str = "kind") -> DataFrame:
    """Directional edge counts between the scopes of both ends, per role."""
    ends = nodes.select("node_id", F.col(scope).alias("scope"))
    joined = edges.join(ends.select(F.col("node_id").alias("src"), F.col("scope").alias("from_scope")), "src").join(ends.select(F.col("node_id").alias("dst"), F.col("scope").alias("to_scope")), "dst")
    return joined.groupBy("from_scope", "to_scope", "role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("relation").alias("n_relations"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    touched = edges.select(F.col("src").alias("node_id")).union(edges.select("dst"))
    return nodes.join(touched, "node_id", "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that no node has."""
    known = nodes.select(F.col("node_id").alias("_id"))
    from_missing = edges.join(known, F.col("src") == F.col("_id"), "left_anti")
    return from_missing.union(edges.join(known, F.col("dst") == F.col("_id"), "left_anti")).distinct()


def rollup(nodes: DataFrame, levels: list[str]) -> DataFrame:
    """Members at each level of a hierarchy of scopes; deeper levels are null above them."""
    return nodes.rollup(*levels).agg(F.count(F.lit(1)).alias("members"), F.grouping_id().cast("int").alias("level"))
