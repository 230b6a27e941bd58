"""Incremental units: plans that reuse earlier results, and drift between generations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unit_plan(units: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows (id, action, reason): a unit (id, digest, contract) is reused when the cache has its digest under its contract."""
    held = cache.select("id", F.col("digest").alias("_digest"), F.col("contract").alias("_contract"))
    joined = units.join(held, "id", "left")
    reason = F.when(F.col("_digest").isNull(), "new").when(F.col("_contract") != F.col("contract"), "contract_changed").when(F.col("_digest") != F.col("digest"), "content_changed").otherwise("hit")
    return joined.select("id", F.when(reason == "hit", "reuse").otherwise("produce").alias("action"), reason.alias("reason"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (id, old, new, cause) of ids whose outcome changed; the cause is the first input that differs."""
    old = before.select("id", F.col("outcome").alias("old"), F.col("definition").alias("d0"), F.col("evidence").alias("e0"))
    joined = old.join(after.select("id", F.col("outcome").alias("new"), "definition", "evidence"), "id", "full_outer")
    cause = F.when(F.col("old").isNull(), "appeared").when(F.col("new").isNull(), "vanished").when(F.col("d0") != F.col("definition"), "definition").when(F.col("e0") != F.col("evidence"), "evidence").otherwise("unexplained")
    return joined.where("NOT (old <=> new)").select("id", "old", "new", cause.alias("cause"))
