"""Differences of snapshots, inventories and record sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inventory_diff(parent: DataFrame, current: DataFrame) -> DataFrame:
    """Rows (path, state, renamed_from) of inventories (path, digest): added, deleted, modified or unchanged.

    An added path whose digest exactly one deleted path has, and that no other added path has, is
    a rename of it.
    """
    old, new = parent.select("path", F.col("digest").alias("old")), current.select("path", F.col("digest").alias("new"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    joined = old.join(new, "path", "full_outer").withColumn("state", state)
    by_digest = joined.groupBy(F.coalesce("new", "old").alias("digest")).agg(F.count_if(F.col("state") == "added").alias("a"), F.count_if(F.col("state") == "deleted").alias("d"), F.min(F.when(F.col("state") == "deleted", F.col("path"))).alias("renamed_from"))
    renames = by_digest.where("a = 1 AND d = 1").select("digest", "renamed_from")
    matched = joined.join(renames, (F.col("state") == "added") & (F.col("new") == F.col("digest")), "left")
    return matched.select("path", "state", "renamed_from")


def record_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows (id, state) of records (id, digest): missing, extra or stale (another digest); equal ones are left out."""
    old, new = expected.select("id", F.col("digest").alias("want")), actual.select("id", F.col("digest").alias("have"))
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("have"), "stale")
    return old.join(new, "id", "full_outer").select("id", state.alias("state")).where("state IS NOT NULL")


def multiset_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose multiplicity differs, with both counts; empty when the multisets are equal."""
    tagged = left.select(*columns, F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(*columns, F.lit(0), F.lit(1)))
    return tagged.groupBy(*columns).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right")).where("n_left <> n_right")


def checked_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of (id, digest, ...) records; the same id with another digest raises when read."""
    both = left.unionByName(right)
    merged = both.groupBy("id").agg(F.min("digest").alias("digest"), F.max("digest").alias("_other"))
    return merged.select("id", F.when(F.col("digest") == F.col("_other"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("digest collision for "), F.col("id").cast("string")))).alias("digest"))


def totality(expected: DataFrame, receipts: DataFrame) -> DataFrame:
    """Units (id) that don't have exactly one receipt: (id, n_receipts, expected)."""
    counted = receipts.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    joined = expected.select("id", F.lit(True).alias("expected")).join(counted, "id", "full_outer")
    return joined.select("id", F.coalesce("n", F.lit(0)).alias("n_receipts"), F.coalesce("expected", F.lit(False)).alias("expected")).where("n_receipts <> 1 OR NOT expected")
