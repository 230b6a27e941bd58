"""Identity between what code declares and what documents mention: components, driven to terminal states.

Candidates (mention_id, basis, file, line, surface) are declarations of code; those of one exact basis are one thing. Documentary mentions (mention_id, file, line, surface) are
the same thing as the candidate at their very place and surface. Reviewed constraints (left, right, disposition: must_link or another, kind) add links or forbid them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.components import connected_components
from lodegraph.runtime import checkpoint

DISPOSITIONS = ("joined", "unresolved", "cannot_link", "terminal_incomplete")
#: Constraints of these kinds block a component, whatever their disposition.
BLOCKING = ("namespace", "type", "incompatible_time")
_PLACE = ["file", "line", "surface"]


def occurrences(candidates: DataFrame, documentary: DataFrame) -> DataFrame:
    """Rows (mention_id, n_places, documentary_id) of candidates whose place documents mention; more than one mention there is ambiguous. Places are counted before the join."""
    places = documentary.groupBy(*_PLACE).agg(F.countDistinct("mention_id").alias("n_places"), F.min("mention_id").alias("documentary_id"))
    return candidates.select("mention_id", *_PLACE).join(places, _PLACE).select("mention_id", "n_places", "documentary_id")


def identity_components(candidates: DataFrame, documentary: DataFrame, constraints: DataFrame) -> DataFrame:
    """Rows (mention_id, side, component, status, n_code, n_documentary): every mention of both sides in one component, its least mention.

    Links are stars around each basis's least mention, the unambiguous places, and must_link constraints. A component is blocked by any other constraint, or
    one of a blocking kind, with both ends in it; else it is resolved if it has a candidate, and unresolved if it has none. A component of one side only is kept, as by a full outer join.
    """
    anchors = candidates.groupBy("basis").agg(F.min("mention_id").alias("anchor"))
    stars = candidates.join(anchors, "basis").select(F.col("mention_id").alias("a"), F.col("anchor").alias("b"))
    placed = occurrences(candidates, documentary).where("n_places = 1").select("mention_id", "documentary_id")
    linked = constraints.where("disposition = 'must_link'").select("left", "right")
    found = connected_components(stars.union(placed).union(linked), "a", "b")
    mentions = candidates.select("mention_id", F.lit("code").alias("side")).union(documentary.select("mention_id", F.lit("documentary"))).distinct()
    members = checkpoint(mentions.join(found, F.col("mention_id") == F.col("node"), "left").select("mention_id", "side", F.coalesce("component", "mention_id").alias("component")))
    barred = constraints.where((F.col("disposition") != "must_link") | F.col("kind").isin(*BLOCKING)).select("left", "right").distinct()
    at = lambda end: members.select(F.col("mention_id").alias(end), F.col("component").alias(f"_{end}")).distinct()
    blocked = barred.join(at("left"), "left").join(at("right"), "right").where("_left = _right").select(F.col("_left").alias("component")).distinct().withColumn("blocked", F.lit(True))
    counted = members.groupBy("component").agg(F.count_if(F.col("side") == "code").alias("n_code"), F.count_if(F.col("side") == "documentary").alias("n_documentary"))
    state = F.when(F.col("blocked"), "blocked").when(F.col("n_code") > 0, "resolved").otherwise("unresolved")
    states = counted.join(blocked, "component", "left").select("component", state.alias("status"), "n_code", "n_documentary")
    return members.join(states, "component").select("mention_id", "side", "component", "status", "n_code", "n_documentary")


def join_receipts(candidates: DataFrame, documentary: DataFrame, constraints: DataFrame) -> DataFrame:
    """Rows (mention_id, fact_kind, component, n_documentary, disposition, referent): each candidate ends in one of the four dispositions.

    `joined` reaches a documentary mention, `unresolved` reaches none, `cannot_link` is blocked, and `terminal_incomplete` has more than one mention at its place or no basis, so that nothing can be said.
    """
    states = identity_components(candidates.where("basis IS NOT NULL"), documentary, constraints).where("side = 'code'").drop("side", "n_code")
    doubtful = occurrences(candidates, documentary).where("n_places > 1").select("mention_id").distinct().withColumn("doubtful", F.lit(True))
    joined = candidates.select("mention_id", "fact_kind").join(states, "mention_id", "left").join(doubtful, "mention_id", "left")
    disposition = (
        F.when(F.col("status") == "blocked", "cannot_link").when(F.col("doubtful") | F.col("status").isNull(), "terminal_incomplete").when(F.col("n_documentary") > 0, "joined").otherwise("unresolved")
    )
    made = joined.withColumn("disposition", disposition)
    return made.select("mention_id", "fact_kind", "component", F.coalesce("n_documentary", F.lit(0)).alias("n_documentary"), "disposition", F.when(F.col("disposition") == "joined", F.col("component")).alias("referent"))


def traversable(relations: DataFrame, receipts: DataFrame) -> DataFrame:
    """Relations (relation_id, edge_kind, from_mention, to_mention, status) that can be walked: resolved, and both ends have a referent; rows (relation_id, edge_kind, from_referent, to_referent)."""
    known = receipts.where("referent IS NOT NULL").select("mention_id", "referent")
    end = lambda side: known.select(F.col("mention_id").alias(f"{side}_mention"), F.col("referent").alias(f"{side}_referent"))
    return relations.where("status = 'resolved'").join(end("from"), "from_mention").join(end("to"), "to_mention").select("relation_id", "edge_kind", "from_referent", "to_referent")


def anchored(relations: DataFrame, locators: DataFrame) -> DataFrame:
    """Ends of relations (relation_id, end, repo, file, line, fact_kind) anchored to the candidate (mention_id) at their locator; two candidates at one locator anchor nothing."""
    keys = ["repo", "file", "line", "fact_kind"]
    single = locators.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("mention_id").alias("mention_id"))
    joined = relations.join(single, keys, "left")
    state = F.when(F.col("n") == 1, "anchored").when(F.col("n") > 1, "ambiguous_locator").otherwise("no_candidate")
    return joined.select("relation_id", "end", F.when(F.col("n") == 1, F.col("mention_id")).alias("mention_id"), state.alias("state"))
