"""Comparison of claims in buckets, constrained identity, membership and confidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators import pairing
from lodegraph.operators.components import connected_components
from lodegraph.runtime import checkpoint, written

#: Propositions that a bucket of the ten-class comparison may have; larger ones are listed instead.
BUCKET_CAP = 40


def bucket_sizes(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (*keys, n, pairs) with the pairs that comparing inside each bucket takes."""
    n = F.count(F.lit(1))
    return claims.groupBy(*keys).agg(n.alias("n"), (n * (n - 1) / 2).cast("long").alias("pairs"))


def pair_classes(claims: DataFrame, keys: list[str], cap: int | None = None, block: int = pairing.BLOCK) -> DataFrame:
    """Rows (*keys, left_id, right_id, class) of every pair of claims in a bucket; with a `cap`, in buckets of at most `cap` claims only.

    Claims have id, polarity, modality, and objects (an array). Precedence: disjoint objects are
    incomparable; opposed polarity is a conflict; then modality; equal objects are equivalent; an
    overlap of half the smaller set is compatible; the rest is ambiguous. Buckets of over `block`
    claims are compared in cells, so that no task has more to do for a larger bucket.
    """
    return pairing.classed(_cells(claims, keys, cap, block), keys)


def pair_class_counts(claims: DataFrame, keys: list[str], cap: int | None = None, block: int = pairing.BLOCK) -> DataFrame:
    """Rows (class, n): the pairs of `pair_classes` by class, counted where they meet."""
    return pairing.counted(_cells(claims, keys, cap, block), keys)


def _cells(claims: DataFrame, keys: list[str], cap: int | None, block: int) -> DataFrame:
    sizes = written(bucket_sizes(claims, keys))
    if cap is not None:
        sizes = sizes.where(F.col("n") <= cap)
        claims = claims.join(sizes.select(*keys), keys, "left_semi")
    return pairing.cells(claims, keys, sizes, block)


def constrained_union(equivalences: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Rows (id, group): ordered merges of (left, right) pairs, refusing those that would join a forbidden pair.

    Only ids of one unconstrained component can meet. A component without a forbidden pair is one
    group, as found by joins; only the others are merged in order, each in its own group of rows. A
    refused merge doesn't block later ones.
    """
    reached = checkpoint(connected_components(equivalences, "left", "right"))
    other = reached.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    within = forbidden.join(reached, F.col("left") == F.col("node")).join(other, F.col("right") == F.col("_node")).where("component = _component")
    walls = checkpoint(within.select("component", "left", "right", F.lit(False).alias("join")).distinct())
    walled = walls.select("component").distinct()
    free = reached.join(walled, "component", "left_anti").select(F.col("node").alias("id"), F.col("component").alias("group"))
    held = reached.join(walled, "component", "left_semi")
    pairs = equivalences.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct().join(held, F.col("left") == F.col("node")).select("component", "left", "right", F.lit(True).alias("join"))

    def merge(table: pd.DataFrame) -> pd.DataFrame:
        joins = table[table["join"]].sort_values(["left", "right"])
        ids = sorted({*joins["left"], *joins["right"]})
        group, members = {i: i for i in ids}, {i: {i} for i in ids}
        apart: dict = {}
        for a, b in table.loc[~table["join"], ["left", "right"]].itertuples(index=False):
            apart.setdefault(a, set()).add(b)
            apart.setdefault(b, set()).add(a)
        for a, b in joins[["left", "right"]].itertuples(index=False):
            keep, gone = sorted((group[a], group[b]))
            if keep == gone or any(apart.get(x, set()) & members[keep] for x in members[gone]):
                continue
            members[keep] |= members.pop(gone)
            for x in members[keep]:
                group[x] = keep
        return pd.DataFrame({"id": ids, "group": [group[i] for i in ids]})

    kind = dict(equivalences.dtypes)["left"]
    return free.union(pairs.union(walls).groupBy("component").applyInPandas(merge, f"id {kind}, group {kind}"))


def membership(holds: Column, known: Column, closed_world: bool) -> Column:
    """member, not_member or abstain: an open world, or a missing field, never says not_member."""
    return F.when(holds, "member").when(F.lit(closed_world) & known, "not_member").otherwise("abstain")


def confidence(kinds: Column, contested: Column) -> Column:
    """From the distinct witness kinds alone: contested, certain (two or more), likely (one), plausible (none)."""
    n = F.size(F.array_distinct(kinds))
    return F.when(contested, "contested").when(n >= 2, "certain").when(n == 1, "likely").otherwise("plausible")
