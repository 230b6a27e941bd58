"""Ledgers and snapshots: what stands, what went, what was replaced, what was answered before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import slug
from lodegraph.operators.joins import first_by
from lodegraph.runtime import checkpoint


def reconciled(prior: DataFrame, current: DataFrame, derived: DataFrame, key: str, observed: str) -> DataFrame:
    """Rows (key, state, first_observed) of refusals of two generations.

    One that still stands keeps its first observation; one that is gone is `superseded_by_derivation` if its subject is derived now, else `withdrawn`.
    """
    seen = lambda df, name: df.groupBy(key).agg(F.min(observed).alias(name), F.count(F.lit(1)).alias(f"n{name}"))
    joined = seen(prior, "_was").join(seen(current, "_is"), key, "full").join(derived.select(key).distinct().withColumn("_derived", F.lit(True)), key, "left")
    state = F.when(F.col("n_is") > 0, "refused").when(F.col("_derived"), "superseded_by_derivation").otherwise("withdrawn")
    return joined.select(key, state.alias("state"), F.coalesce("_was", "_is").alias("first_observed"))


def append_only(previous: DataFrame, following: DataFrame, ledger: str, position: str, content: str) -> DataFrame:
    """Rows (ledger, n_previous, n_added, n_broken, append_only): whether each ledger begins with all of its earlier entries, unchanged."""
    was = previous.select(ledger, position, F.col(content).alias("_was"), F.lit(1).alias("_p"))
    joined = was.join(following.select(ledger, position, F.col(content).alias("_is"), F.lit(1).alias("_f")), [ledger, position], "full")
    old, added = F.col("_p").isNotNull(), F.col("_p").isNull()
    broken = old & (F.col("_f").isNull() | ~F.col("_was").eqNullSafe(F.col("_is")))
    counted = joined.groupBy(ledger).agg(F.count_if(old).alias("n_previous"), F.count_if(added).alias("n_added"), F.count_if(broken).alias("n_broken"), F.max(F.when(old, F.col(position))).alias("_last"), F.min(F.when(added, F.col(position))).alias("_first"))
    held = (F.col("n_broken") == 0) & F.coalesce(F.col("_first") > F.col("_last"), F.lit(True))
    return counted.select(ledger, "n_previous", "n_added", "n_broken", held.alias("append_only"))


def shared_keys(classes: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows (key, classes): keys that stand in more than one class; none if the classes are disjoint."""
    tagged = reduce(DataFrame.union, [df.select(key).distinct().withColumn("_class", F.lit(name)) for name, df in sorted(classes.items())])
    return tagged.groupBy(key).agg(F.array_sort(F.collect_list("_class")).alias("_held")).where(F.size("_held") > 1).select(key, F.array_join("_held", ",").alias("classes"))


def window_conservation(blocks: DataFrame, windows: DataFrame, key: str, block: str, first: str, last: str) -> DataFrame:
    """Rows (key, n_blocks, n_missing, n_doubled, n_foreign, conserved): whether the windows of a text partition its blocks."""
    covered = windows.select(key, F.explode(F.sequence(F.col(first).cast("long"), F.col(last).cast("long"))).alias("_block")).groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    joined = blocks.select(key, F.col(block).cast("long").alias("_block"), F.lit(1).alias("_b")).join(covered, [key, "_block"], "full")
    counted = joined.groupBy(key).agg(F.count("_b").alias("n_blocks"), F.count_if(F.col("_n").isNull()).alias("n_missing"), F.count_if(F.col("_n") > 1).alias("n_doubled"), F.count_if(F.col("_b").isNull()).alias("n_foreign"))
    return counted.withColumn("conserved", F.col("n_missing") + F.col("n_doubled") + F.col("n_foreign") == 0)


def canon(discovered: DataFrame, documented: DataFrame, name: str) -> DataFrame:
    """Rows (entity, state, n_witnesses) by slug: `matched`, `discovered_undocumented` or `documented_unwitnessed`."""
    found = discovered.groupBy(slug(F.col(name)).alias("entity")).agg(F.count(F.lit(1)).alias("_w"))
    joined = found.join(documented.select(slug(F.col(name)).alias("entity"), F.lit(True).alias("_d")).distinct(), "entity", "full")
    state = F.when(F.col("_w").isNotNull() & F.col("_d").isNotNull(), "matched").when(F.col("_w").isNotNull(), "discovered_undocumented").otherwise("documented_unwitnessed")
    return joined.select("entity", state.alias("state"), F.coalesce("_w", F.lit(0)).alias("n_witnesses"))


def replacement_faults(claims: DataFrame, key: str, replaces: str) -> DataFrame:
    """Rows (key, fault) of claims (unique key) that name the one claim that they replace.

    `missing`: there is no such claim; `fork`: another claim replaces it as well; `endless`: the chain runs into a cycle.
    Chains are followed by doubling: a round that no chain ends in leaves only endless ones, so rounds are logarithmic.
    """
    links = claims.where(F.col(replaces).isNotNull()).select(F.col(key).alias("_key"), F.col(replaces).alias("_to"))
    known = claims.select(F.col(key).alias("_to"))
    fault = lambda df, name: df.select(F.col("_key").alias(key), F.lit(name).alias("fault"))
    forked = links.join(links.groupBy("_to").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "_to")
    held = checkpoint(links.join(known, "_to", "left_semi").select("_key", "_to"))
    n = held.count()
    while n:
        held = checkpoint(held.join(held.select(F.col("_key").alias("_to"), F.col("_to").alias("_next")), "_to").select("_key", F.col("_next").alias("_to")))
        before, n = n, held.count()
        if n == before:
            break
    return fault(links.join(known, "_to", "left_anti"), "missing").union(fault(forked, "fork")).union(fault(held, "endless"))


def claim_status(versions: DataFrame, claim: str, version: str, captured: str, current: Column) -> DataFrame:
    """Rows (claim, status, first_version, n_versions): current while any supporting version is; the first version by capture, then id."""
    first = F.min(F.struct(F.col(captured).alias("c"), F.col(version).alias("v")))
    return versions.groupBy(claim).agg(F.when(F.bool_or(F.coalesce(current, F.lit(False))), "current").otherwise("historical").alias("status"), first.getField("v").alias("first_version"), F.count(F.lit(1)).alias("n_versions"))


def answer_plan(windows: DataFrame, journals: DataFrame, key: str, digest: str, answer: str, priority: list[str]) -> DataFrame:
    """Rows (key, digest, state, answer): an answer given to a window of the same content is reused; of several journals the earlier wins."""
    merged = first_by(journals.where(F.col(digest).isNotNull()), [digest], priority).select(digest, F.col(answer).alias("answer"), F.lit(True).alias("_found"))
    joined = windows.select(key, digest).join(merged, digest, "left")
    return joined.select(key, digest, F.when(F.col("_found"), "reused").otherwise("ask").alias("state"), "answer")


def latest_outcomes(ledger: DataFrame, key: str, order: list[str], outcome: str) -> DataFrame:
    """Rows (key, outcome, n_entries, n_repairs): the last entry decides; a repair is an entry with another outcome than the last."""
    last = ledger.groupBy(key, F.col(outcome).alias("_o")).agg(F.max(F.struct(*order)).alias("_at"), F.count(F.lit(1)).alias("_n"))
    folded = last.groupBy(key).agg(F.max(F.struct("_at", "_o", "_n")).alias("b"), F.sum("_n").alias("n_entries"))
    return folded.select(key, F.col("b._o").alias("outcome"), "n_entries", (F.col("n_entries") - F.col("b._n")).alias("n_repairs"))


def active_vector(census: DataFrame, resolved: DataFrame, family: str, item: str) -> DataFrame:
    """Rows (family, n, n_resolved, n_active): open items per family less those with a resolution of this corpus; an item counts once."""
    done = resolved.select(family, item).distinct().withColumn("_done", F.lit(1))
    joined = census.select(family, item).distinct().join(done, [family, item], "left")
    counted = joined.groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.count("_done").alias("n_resolved"))
    return counted.withColumn("n_active", F.col("n") - F.col("n_resolved"))
