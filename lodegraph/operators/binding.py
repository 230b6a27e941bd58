"""Bindings: references tried on several bases in order, path aliases, declared against bound names, anchors under a pin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.joins import candidates, first_by


def resolve_in_order(refs: DataFrame, ref_id: str, steps: list[tuple[str, str, DataFrame, str, str]]) -> DataFrame:
    """Rows (ref_id, basis, status, target, n_candidates): the first basis with a candidate decides, also if it is ambiguous.

    Steps are (basis, key of refs, targets, target, key of targets). Targets are grouped by key, so each step adds one join and no rows.
    """
    wide, counts, firsts = refs, [], []
    for i, (_, key, targets, target, target_key) in enumerate(steps):
        listed = candidates(targets, target, target_key, 1).select(F.col("_key").alias(f"_key{i}"), F.col("n_candidates").alias(f"_n{i}"), F.get("_first", F.lit(0)).alias(f"_t{i}"))
        wide = wide.join(listed, F.col(key) == F.col(f"_key{i}"), "left")
        counts.append(F.col(f"_n{i}"))
        firsts.append(F.when(F.col(f"_n{i}") == 1, F.col(f"_t{i}").cast("string")))
    basis = F.coalesce(*[F.when(n.isNotNull(), F.lit(step[0])) for n, step in zip(counts, steps, strict=True)])
    target = F.when(F.lit(False), F.lit(""))
    for n, t in zip(counts, firsts, strict=True):
        target = target.when(n.isNotNull(), t)
    found = wide.select(ref_id, basis.alias("basis"), target.alias("target"), F.coalesce(*counts, F.lit(0)).alias("n_candidates"))
    status = F.when(F.col("n_candidates") == 0, "unresolved").when(F.col("n_candidates") == 1, "resolved").otherwise("ambiguous")
    return found.select(ref_id, "basis", status.alias("status"), "target", "n_candidates")


def alias_targets(refs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows (ref_id, pattern, path) of refs (ref_id, scope, name) under patterns (scope, pattern, target) of their scope.

    A pattern without a star takes the very name; one with a star takes names with its two ends, and what the star stood for
    goes where the target has a star. An exact pattern wins, then the longest beginning, then the longest end. The joins are on beginnings cut at
    the lengths that patterns of the scope have.
    """
    star = F.contains(F.col("pattern"), F.lit("*"))
    cut = F.split("pattern", "[*]", 2)
    made = patterns.select("scope", "pattern", "target", star.alias("_star"), cut[0].alias("_head"), F.when(star, cut[1]).alias("_tail"))
    lengths = made.select("scope", "_star", F.length("_head").alias("_n")).distinct()
    tried = refs.join(lengths, "scope").where((F.col("_star") & (F.length("name") >= F.col("_n"))) | (~F.col("_star") & (F.length("name") == F.col("_n"))))
    joined = tried.withColumn("_head", F.substring("name", F.lit(1), F.col("_n"))).join(made, ["scope", "_star", "_head"])
    ends = joined.where(~F.col("_star") | (F.endswith("name", "_tail") & (F.length("name") >= F.col("_n") + F.length("_tail"))))
    middle = F.substring("name", F.col("_n") + 1, F.length("name") - F.col("_n") - F.length("_tail"))
    best = first_by(ends, ["ref_id"], [F.col("_star"), F.desc("_n"), F.desc(F.length("_tail")), F.col("pattern"), F.col("target")])
    return best.select("ref_id", "pattern", F.when(F.col("_star"), F.replace(F.col("target"), F.lit("*"), middle)).otherwise(F.col("target")).alias("path"))


def package_root(specifier: Column) -> Column:
    """The package of an import: the first segment, or two after an at sign; lower case, with `-` for `_` and `.`. Null for relative and absolute paths."""
    root = F.regexp_extract(specifier, "^(@[^/]+/[^/]+|[^@./][^/]*)", 1)
    return F.when(root != "", F.regexp_replace(F.lower(root), "[_.]", "-"))


def wiring(declared: DataFrame, bound: DataFrame, opaque: DataFrame, owner: str, name: str) -> DataFrame:
    """Rows (owner, name, state): `wired` if bound; else `undeterminable` if the owner also binds in ways that can't be read; else `declared_unwired`."""
    sites = bound.select(owner, name).distinct().withColumn("_bound", F.lit(True))
    joined = declared.select(owner, name).distinct().join(sites, [owner, name], "left").join(opaque.select(owner).distinct().withColumn("_opaque", F.lit(True)), owner, "left")
    return joined.select(owner, name, F.when(F.col("_bound"), "wired").when(F.col("_opaque"), "undeterminable").otherwise("declared_unwired").alias("state"))


def bound_by_content(anchors: DataFrame, held: DataFrame, anchor: str) -> DataFrame:
    """Rows (anchor, state) of anchors (anchor, scope, pin, path, blob) against a graph's files (scope, pin, path, blob).

    `bound` needs the scope's pin, the path and the content; else the first of `not_in_graph` (no such scope), `pin_differs`, `file_version_differs`,
    `same_content_other_path`, `not_in_graph`. Each lookup is on distinct keys, so anchors are never multiplied.
    """
    pins = held.groupBy("scope").agg(F.min("pin").alias("_pin"))
    at = held.select("scope", "path", "blob").distinct().withColumn("_same", F.lit(True))
    paths = held.select("scope", "path").distinct().withColumn("_path", F.lit(True))
    blobs = held.select("scope", "blob").distinct().withColumn("_blob", F.lit(True))
    joined = anchors.join(pins, "scope", "left").join(at, ["scope", "path", "blob"], "left").join(paths, ["scope", "path"], "left").join(blobs, ["scope", "blob"], "left")
    state = (
        F.when(F.col("_pin").isNull(), "not_in_graph").when(~F.col("pin").eqNullSafe(F.col("_pin")), "pin_differs").when(F.col("_same"), "bound")
        .when(F.col("_path"), "file_version_differs").when(F.col("_blob"), "same_content_other_path").otherwise("not_in_graph")
    )
    return joined.select(anchor, state.alias("state"))
