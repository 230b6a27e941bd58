"""Selections with what they leave out: splits, batches, orders of trial, previews, bounded views, summaries of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def directory_split(directory: Column) -> Column:
    """`design` or `heldout` by the parity of the first byte of a directory's hash, so that no directory is in both."""
    return F.when(F.conv(F.substring(F.sha2(directory, 256), 1, 2), 16, 10).cast("int") % 2 == 0, "design").otherwise("heldout")


def trial_order(questions: DataFrame, question: str, arms: list[str], repetitions: int, seed: str) -> DataFrame:
    """Rows (question, repetition, nth, arm): all arms of each repetition in seeded order."""
    tried = questions.select(question).distinct().withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions)))).withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(question).cast("string"), F.col("repetition").cast("string"), "arm"), 256)
    return tried.select(question, "repetition", F.row_number().over(Window.partitionBy(question, "repetition").orderBy(order)).alias("nth"), "arm")


def component_batch(groups: DataFrame, component: str, n: str, after: object, size: int) -> DataFrame:
    """Rows (component, n, upto, n_deferred): whole groups after a cursor until they hold `size` rows; the rest is counted.

    A group has a row at least, so the batch lies within the first `size` groups: only those are brought into one order.
    """
    left = groups.where((F.col(component) > F.lit(after)) & (F.col(n) > 0))
    total = left.count()
    bounded = left.orderBy(component).limit(size)
    held = bounded.withColumn("upto", F.sum(n).over(Window.orderBy(component).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") - F.col(n) < size)
    return held.select(component, n, "upto", (F.lit(total) - F.count(F.lit(1)).over(Window.partitionBy())).alias("n_deferred"))


def offset_page(rows: DataFrame, order: list[str], skip: int, n: int) -> DataFrame:
    return rows.orderBy(*order).offset(skip).limit(n)


def previews(rows: DataFrame, by: str, order: list[str | Column], budget: int) -> DataFrame:
    """The first `budget` rows of each group, with nth and n (the exact size of the group). Ranks are cut before the shuffle's sort is kept; sizes are counted apart."""
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("nth") <= budget).join(sizes, by)


def bounded_view(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, most_nodes: int, most_edges: int) -> DataFrame:
    """Rows (item, id, nth, omitted) of a view of at most so many nodes and edges: seeds first, then nodes by degree, then id.

    Edges run between shown nodes, by the worse rank of their ends; omitted counts all nodes, and all edges between any nodes, that aren't shown.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("_degree"))
    seeded = seeds.select("node_id").distinct().withColumn("_seed", F.lit(0))
    ranked = nodes.select("node_id").join(ends, "node_id", "left").join(seeded, "node_id", "left")
    order = [F.coalesce("_seed", F.lit(1)), F.desc(F.coalesce("_degree", F.lit(0))), F.col("node_id")]
    shown = ranked.orderBy(*order).limit(most_nodes).withColumn("nth", F.row_number().over(Window.orderBy(*order))).select("node_id", "nth")
    few = F.broadcast(shown)  # `most_nodes` rows
    between = edges.select("edge_id", "src", "dst").join(few.select(F.col("node_id").alias("src"), F.col("nth").alias("_a")), "src").join(few.select(F.col("node_id").alias("dst"), F.col("nth").alias("_b")), "dst")
    edge_order = [F.greatest("_a", "_b"), F.col("edge_id")]
    drawn = between.orderBy(*edge_order).limit(most_edges).withColumn("nth", F.row_number().over(Window.orderBy(*edge_order)))
    rows = shown.select(F.lit("node").alias("item"), F.col("node_id").alias("id"), "nth").union(drawn.select(F.lit("edge"), "edge_id", "nth"))
    totals = F.when(F.col("item") == "node", F.lit(nodes.count())).otherwise(F.lit(edges.count()))
    return rows.withColumn("omitted", totals - F.count(F.lit(1)).over(Window.partitionBy("item")))


def summaries(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (community, n_members, kinds, n_internal, n_outbound, n_inbound) of members (node_id, community, kind): each node is in one community.

    Kinds are a histogram `kind=n` in order of the kinds. Edges to nodes without a community are outbound as well.
    """
    counted = members.groupBy("community", "kind").agg(F.count(F.lit(1)).alias("_n"))
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "_n"))), lambda s: F.concat_ws("=", s["kind"], s["_n"].cast("string"))), ",")
    sized = counted.groupBy("community").agg(F.sum("_n").alias("n_members"), kinds.alias("kinds"))
    end = lambda name, as_: members.select(F.col("node_id").alias(name), F.col("community").alias(as_))
    pairs = edges.select("src", "dst").join(end("src", "_from"), "src", "left").join(end("dst", "_to"), "dst", "left").groupBy("_from", "_to").agg(F.count(F.lit(1)).alias("_n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("_from").alias("community"), F.lit(True).alias("out")), F.struct(F.col("_to").alias("community"), F.lit(False).alias("out")))).alias("s"), F.col("_from").eqNullSafe(F.col("_to")).alias("same"), "_n")
    flows = sides.where("s.community IS NOT NULL").groupBy(F.col("s.community").alias("community")).agg(
        F.coalesce(F.sum(F.when(F.col("same") & F.col("s.out"), F.col("_n"))), F.lit(0)).alias("n_internal"), F.coalesce(F.sum(F.when(~F.col("same") & F.col("s.out"), F.col("_n"))), F.lit(0)).alias("n_outbound"),
        F.coalesce(F.sum(F.when(~F.col("same") & ~F.col("s.out"), F.col("_n"))), F.lit(0)).alias("n_inbound"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return sized.join(flows, "community", "left").select("community", "n_members", "kinds", zero("n_internal"), zero("n_outbound"), zero("n_inbound"))


def recall_estimate(samples: DataFrame, population: DataFrame, stratum: str, positive: Column, found: Column) -> DataFrame:
    """One row (n_sampled, positives, recall): rates of each stratum's sample, weighted by the stratum's size; strata without a sample don't count."""
    rates = samples.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"), F.count_if(positive).alias("_p"), F.count_if(positive & found).alias("_t"))
    sized = rates.join(population.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size")), stratum)
    weighted = lambda c: F.sum(F.col("_size") * F.col(c) / F.col("_n"))
    total = sized.agg(F.sum("_n").alias("n_sampled"), weighted("_p").alias("_positives"), weighted("_t").alias("_found"))
    return total.select("n_sampled", F.round("_positives", 6).alias("positives"), F.when(F.col("_positives") > 0, F.round(F.col("_found") / F.col("_positives"), 9)).alias("recall"))
