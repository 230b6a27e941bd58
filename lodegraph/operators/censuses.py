"""Censuses and rollups: counts with bounded examples, shares, costs with unknowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.operators.components import connected_components


def with_examples(rows: DataFrame, by: list[str], subject: str, most: int = 5) -> DataFrame:
    """Rows (*by, n, n_subjects, examples): the first `most` subjects of each group; they are ranked before they are collected."""
    counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(subject).alias("n_subjects"))
    ranked = rows.select(*by, subject).distinct().withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(subject))).where(F.col("_nth") <= most)
    listed = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(subject)).alias("examples"))
    return counted.join(listed, by)


def top_and_rest(rows: DataFrame, name: str, size: Column, keep: int = 14) -> DataFrame:
    """Rows (name, n, bytes): the `keep` names with most rows, and all others as one row."""
    summed = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    first = summed.orderBy(F.desc("n"), name).limit(keep).select(F.col(name).alias("_name"))
    named = summed.join(F.broadcast(first), F.col(name) == F.col("_name"), "left")  # `keep` rows
    return named.groupBy(F.coalesce("_name", F.lit("other")).alias(name)).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def spending(rows: DataFrame, by: list[str], estimated: Column, actual: Column) -> DataFrame:
    """Rows (*by, n, estimated, known, actual): what is known is summed apart; actual is null unless every row reports one."""
    known = F.sum(actual)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(estimated), 2).alias("estimated"), F.round(F.coalesce(known, F.lit(0.0)), 2).alias("known"), F.when(F.count(actual) == F.count(F.lit(1)), F.round(known, 2)).alias("actual"))


def usage(rows: DataFrame, tier: str, cost: Column) -> DataFrame:
    """Rows (tier, calls, cost, call_share, cost_share, partial): shares of all calls and of known cost; partial if any call of any tier has none."""
    own = rows.groupBy(tier).agg(F.count(F.lit(1)).alias("calls"), F.sum(cost).alias("cost"), F.count_if(cost.isNull()).alias("unpriced"))
    everyone = Window.partitionBy()  # one row per tier
    total, known = F.sum("calls").over(everyone), F.sum("cost").over(everyone)
    return own.select(tier, "calls", F.round("cost", 2).alias("cost"), F.round(F.col("calls") / total, 6).alias("call_share"), F.round(F.col("cost") / known, 6).alias("cost_share"), (F.sum("unpriced").over(everyone) > 0).alias("partial"))


def scored(expected: DataFrame, answered: DataFrame, question: str, item: str) -> DataFrame:
    """Rows (question, n_expected, n_answered, n_right, precision, recall, exact) of sets of items; repeated items count once."""
    joined = expected.select(question, item).distinct().withColumn("_e", F.lit(1)).join(answered.select(question, item).distinct().withColumn("_a", F.lit(1)), [question, item], "full")
    counted = joined.groupBy(question).agg(F.count("_e").alias("n_expected"), F.count("_a").alias("n_answered"), F.count_if(F.col("_e").isNotNull() & F.col("_a").isNotNull()).alias("n_right"))
    rate = lambda n: F.when(F.col(n) > 0, F.round(F.col("n_right") / F.col(n), 9))
    return counted.select(question, "n_expected", "n_answered", "n_right", rate("n_answered").alias("precision"), rate("n_expected").alias("recall"), ((F.col("n_right") == F.col("n_expected")) & (F.col("n_right") == F.col("n_answered"))).alias("exact"))


def majority_parent(members: DataFrame, fine: str, coarse: str) -> DataFrame:
    """Rows (fine, n, parent): the coarse group that holds more than half of a fine group's members, or null."""
    counted = members.groupBy(fine, coarse).agg(F.count(F.lit(1)).alias("k"))
    best = counted.groupBy(fine).agg(F.sum("k").alias("n"), F.max(F.struct("k", coarse)).alias("b"))
    return best.select(fine, "n", F.when(2 * F.col("b.k") > F.col("n"), F.col(f"b.{coarse}")).alias("parent"))


def connectivity(edges: DataFrame, n_nodes: int) -> DataFrame:
    """One row: nodes, components of two or more, their nodes, the giant's size and share, isolated nodes."""
    sizes = connected_components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.count(F.lit(1)).alias("n_components"), F.coalesce(F.sum("n"), F.lit(0)).alias("connected"), F.coalesce(F.max("n"), F.lit(0)).alias("giant"))
    return found.select(F.lit(n_nodes).cast("long").alias("n_nodes"), "n_components", "connected", "giant", F.round(F.col("giant") / n_nodes, 9).alias("giant_share"), (F.lit(n_nodes) - F.col("connected")).alias("isolated"))


def coverage(rows: DataFrame, by: list[str], disposition: Column) -> DataFrame:
    """Rows (*by, disposition, n, share) with the share of the group."""
    counted = rows.groupBy(*by, disposition.alias("disposition")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 9))
