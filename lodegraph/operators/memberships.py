"""Memberships of subjects in concepts with their witnesses, and the questions that are asked of them.

A concept is a mapping: `expression` (a pattern, see `operators.patterns`), `closed_world` (whether absence says not_member) and `role` (whether it needs production evidence).
Witnesses are rows of their own, never lists: an edge that an edge leaf of the concept matched, or, where there is none, the subject's claim.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.operators import patterns
from lodegraph.operators.graph import both_ways
from lodegraph.runtime import checkpoint, dealt, written

PROVENANCE = ("production", "test", "fixture", "docs")
#: Contested ranks lowest: a defeater is no degree of warrant.
CONFIDENCE = ("contested", "plausible", "likely", "certain")


class MissingWitness(ValueError):
    """An outcome was reached that nothing witnesses."""


def edge_leaves(expression: Mapping) -> Iterator[dict]:
    """The edge leaves of a pattern, those under a negation too."""
    name, body = next(iter(expression.items()))
    if name in ("and", "or"):
        for part in body:
            yield from edge_leaves(part)
    elif name == "not":
        yield from edge_leaves(body)
    elif name == "edge_exists":
        yield dict(body)
    elif name == "fact_kind_present":
        yield {"direction": "out", "relation": "contains", **body}


_FIELDS = {"direction": "direction", "relation": "relation", "kind": "other_kind"}


def _matched(spec: Mapping, fields: Mapping[str, str]) -> Column:
    """Whether an edge leaf of a concept agrees with an edge in these fields."""
    out = F.lit(False)
    for leaf in edge_leaves(spec["expression"]):
        test = F.lit(True)
        for field, column in fields.items():
            if field in leaf:
                test = test & (F.col(column) == leaf[field])
        out = out | test
    return out


def edge_witnesses(nodes: DataFrame, edges: DataFrame, concepts: Mapping[str, Mapping], tasks: int = 1) -> DataFrame:
    """Rows (node_id, concept, direction, edge_id, relation, other, other_kind, provenance_class, nth): every edge that an edge leaf of a concept matches, in one pass over the edges.

    Of rows of one node, concept and edge id the one with `nth` 1 is the witness. Edges that no leaf can match by direction and relation are dropped before their ends
    are looked up, and a node's rows move once for all concepts.
    """
    kinds = nodes.select(F.col("node_id").alias("other"), F.col("kind").alias("other_kind"))
    early = F.lit(False)
    for spec in concepts.values():
        early = early | _matched(spec, {field: _FIELDS[field] for field in ("direction", "relation")})
    ends = both_ways(edges, "provenance_class").where(early).select("node", "other", "direction", "relation", "edge_id", "provenance_class")
    seen = dealt(dealt(ends, tasks, "other").join(kinds, "other"), tasks, "node")
    met = F.filter(F.array(*[F.when(_matched(spec, _FIELDS), F.lit(name)) for name, spec in concepts.items()]), lambda c: c.isNotNull())
    found = seen.select(F.col("node").alias("node_id"), F.explode(met).alias("concept"), "direction", "edge_id", "relation", "other", "other_kind", "provenance_class")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("node_id", "concept", "edge_id").orderBy("other", "direction")))


def evaluated(subjects: DataFrame, nodes: DataFrame, edges: DataFrame, concepts: Mapping[str, Mapping], arrays: frozenset[str] = frozenset(), tasks: int = 1) -> tuple[DataFrame, DataFrame]:
    """(memberships, witnesses) of subjects (node_id, claim_id or null, and the fields that patterns read).

    memberships: node_id, concept, outcome (member, not_member, abstain), result, reason, confidence, n_witnesses and the counts of witness edges by provenance class. A role whose
    edges aren't of production is matched but excluded (TEST_OR_FIXTURE_ONLY). Open-world absence abstains (INVENTORY_INCOMPLETE), without witnesses. Confidence is `certain` by an
    edge and `likely` by a claim alone. An outcome without a witness raises MissingWitness.
    """
    matches = written(edge_witnesses(nodes, edges, concepts, tasks))
    view = patterns.viewed(matches.select("node_id", "direction", "relation", F.col("other_kind").alias("kind")), subjects)
    tests = [F.struct(F.lit(name).alias("concept"), patterns.compiled(dict(spec["expression"]), arrays).alias("matched"), F.lit(bool(spec.get("closed_world"))).alias("closed"), F.lit(bool(spec.get("role"))).alias("role")) for name, spec in concepts.items()]
    tried = view.select("node_id", "claim_id", F.explode(F.array(*tests)).alias("t")).select("node_id", "claim_id", "t.*")
    found = matches.where("nth = 1")
    counts = [F.count_if(F.col("provenance_class") == c).alias(f"n_{c}") for c in PROVENANCE]
    summed = found.groupBy("node_id", "concept").agg(F.count(F.lit(1)).alias("n_edges"), *counts)
    joined = tried.join(summed, ["node_id", "concept"], "left").fillna(0, ["n_edges", *(f"n_{c}" for c in PROVENANCE)])
    excluded = F.col("matched") & F.col("role") & (F.col("n_production") == 0)
    outcome = F.when(excluded, "not_member").when(F.col("matched"), "member").when(F.col("closed"), "not_member").otherwise("abstain")
    result = F.when(excluded, "matched_scope_excluded").when(F.col("matched"), "matched").when(F.col("closed"), "not_matched_closed_world").otherwise("insufficient_evidence")
    reason = F.when(excluded, "TEST_OR_FIXTURE_ONLY").when(~F.col("matched") & ~F.col("closed"), "INVENTORY_INCOMPLETE")
    abstains = F.col("outcome") == "abstain"
    claimed = (F.col("n_edges") == 0) & F.col("claim_id").isNotNull()
    witnessed = F.when(abstains, 0).when(claimed, 1).otherwise(F.col("n_edges"))
    confidence = F.when(~abstains, F.when(F.col("n_edges") > 0, "certain").when(claimed, "likely"))
    made = joined.withColumn("outcome", outcome).select(
        "node_id", "concept", "outcome", result.alias("result"), reason.alias("reason"), confidence.alias("confidence"), witnessed.cast("long").alias("n_witnesses"), *[F.when(abstains, 0).otherwise(F.col(f"n_{c}")).cast("long").alias(f"n_{c}") for c in PROVENANCE],
    )
    made = written(made)
    if bare := made.where("outcome <> 'abstain' AND n_witnesses = 0").select("concept", "node_id", "outcome").head(1):
        raise MissingWitness("{} gave {} the outcome {} with no witness".format(*bare[0]))
    settled = made.where("outcome <> 'abstain'").select("node_id", "concept")
    by_edge = found.join(settled, ["node_id", "concept"], "left_semi").select("node_id", "concept", F.lit("projected_edge").alias("kind"), F.col("edge_id").alias("witness"), "relation", "other", "other_kind", "provenance_class")
    none = F.lit(None).cast("string")
    by_claim = settled.join(found, ["node_id", "concept"], "left_anti").join(subjects.select("node_id", F.col("claim_id").cast("string").alias("witness")), "node_id").select("node_id", "concept", F.lit("claim"), "witness", none, none, none, none)
    return made, by_edge.union(by_claim)


def _bounded(rows: DataFrame, order: str, limit: int, most: int) -> DataFrame:
    """The first `limit` rows and whether there are more, by a top-k and not a whole sort."""
    if not 1 <= limit <= most:
        raise ValueError(f"the limit must be from 1 to {most}")
    first = rows.orderBy(order).limit(limit + 1)
    held = checkpoint(first)
    return held.orderBy(order).limit(limit).withColumn("truncated", F.lit(held.count() > limit))


def members(memberships: DataFrame, concept: str, min_confidence: str | None = None, limit: int = 200) -> DataFrame:
    """The first members of a concept by id; the bound comes before the filter on confidence, as surveyed."""
    if min_confidence is not None and min_confidence not in CONFIDENCE:
        raise ValueError(f"the confidence must be one of {', '.join(CONFIDENCE)}")
    found = _bounded(memberships.where((F.col("concept") == concept) & (F.col("outcome") == "member")), "node_id", limit, 2000)
    rank = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col("confidence"))
    return found if min_confidence is None else found.where(F.coalesce(rank, F.lit(0)) > CONFIDENCE.index(min_confidence))


def concepts_of(memberships: DataFrame, node_id: str, limit: int = 50) -> DataFrame:
    return _bounded(memberships.where(F.col("node_id") == node_id), "concept", limit, 500)


def why(memberships: DataFrame, witnesses: DataFrame, concept: str, node_id: str) -> DataFrame:
    """A membership with its witnesses, a row each; an absent membership is an error."""
    mine = (F.col("concept") == concept) & (F.col("node_id") == node_id)
    found = memberships.where(mine).select("node_id", "concept", "outcome", "result", "reason", "confidence")
    if found.isEmpty():
        raise LookupError(f"{node_id} has no membership in {concept}")
    return found.join(witnesses.where(mine), ["node_id", "concept"], "left")


def conflicts(memberships: DataFrame, concept: str, limit: int = 200) -> DataFrame:
    return _bounded(memberships.where((F.col("concept") == concept) & (F.col("confidence") == "contested")), "node_id", limit, 2000)


def contested(memberships: DataFrame, defeaters: DataFrame) -> DataFrame:
    """Memberships whose confidence is `contested` where a defeater (node_id, concept) is active; abstentions have no confidence."""
    active = defeaters.select("node_id", "concept").distinct().withColumn("_active", F.lit(True))
    joined = memberships.join(active, ["node_id", "concept"], "left")
    return joined.withColumn("confidence", F.when(F.col("_active") & (F.col("outcome") != "abstain"), "contested").otherwise(F.col("confidence"))).drop("_active")


def drift(before: DataFrame, after: DataFrame, concept: str, was: Mapping[str, str], now: Mapping[str, str], limit: int = 500) -> DataFrame:
    """Rows (node_id, outcome_a, outcome_b, changed, cause) of a concept in two generations, each side bounded by id.

    The cause is the first of the headers' `definition`, `policy` and `source` (mappings with these keys) that differ, else `evidence`.
    """
    side = lambda df, name: _bounded(df.where(F.col("concept") == concept).select("node_id", F.col("outcome").alias(name)), "node_id", limit, 5000).withColumnRenamed("truncated", f"_{name}")
    cause = next((key for key in ("definition", "policy", "source") if was.get(key) != now.get(key)), "evidence")
    joined = side(before, "outcome_a").join(side(after, "outcome_b"), "node_id", "full")
    return joined.select("node_id", "outcome_a", "outcome_b", (~F.col("outcome_a").eqNullSafe(F.col("outcome_b"))).alias("changed"), F.lit(cause).alias("cause"))
