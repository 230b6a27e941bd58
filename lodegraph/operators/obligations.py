"""Obligations of claims against complete inventories: each is supported, refuted, underdetermined or unverifiable.

Obligations are rows (claim_id, obligation_id, kind, ...) of one table; each kind has one join plan for all of its obligations. Inventories: symbols (name, file, kind);
files (path, text); runs (command, exit_code, matched, error), the results of verification commands run elsewhere. Absence refutes only where the inventory is complete;
else it leaves the obligation underdetermined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.runtime import written

KINDS = ("code_symbol_declared", "source_text_present", "tree_paths_exact", "tree_paths_present", "tree_text_absent", "verification_check_passed", "open_question")
#: How strong what supports an obligation is.
TIERS = {"verification_check_passed": "executed", "code_symbol_declared": "declared", "tree_paths_exact": "declared", "tree_paths_present": "declared", "tree_text_absent": "declared", "source_text_present": "documentary", "open_question": "none"}
#: Columns of an obligation; null where its kind has no use for them.
SCHEMA = "claim_id long, obligation_id long, kind string, symbol string, path string, declaration_kind string, require_unique boolean, line long, quote string, prefix string, paths array<string>, needles array<string>, command string"
_KEYS = ["claim_id", "obligation_id"]


def _result(df: DataFrame, state: Column, n: Column) -> DataFrame:
    return df.select(*_KEYS, "kind", state.alias("state"), n.cast("long").alias("n_evidence"))


def _absent(complete: bool) -> Column:
    return F.lit("refuted" if complete else "underdetermined")


def symbols_declared(obligations: DataFrame, symbols: DataFrame, complete: bool) -> DataFrame:
    """Supported by one declaration, or by any number where uniqueness isn't asked; several are underdetermined. Path and declaration kind narrow the search if given.

    Symbols are counted once for each way of asking, so an obligation meets one count and no name is paired with all of its declarations.
    """
    wanted = obligations.where("kind = 'code_symbol_declared'")
    ways = {(False, False): ["name"], (True, False): ["name", "file"], (False, True): ["name", "kind"], (True, True): ["name", "file", "kind"]}
    parts = []
    for (by_path, by_kind), keys in ways.items():
        asked = wanted.where((F.col("path").isNotNull() == F.lit(by_path)) & (F.col("declaration_kind").isNotNull() == F.lit(by_kind)))
        counted = symbols.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("n"))
        names = {"name": "symbol", "file": "path", "kind": "declaration_kind"}
        parts.append(asked.join(counted, [F.col(names[k]) == F.col(f"_{k}") for k in keys], "left").select(*_KEYS, "kind", "require_unique", F.coalesce("n", F.lit(0)).alias("n")))
    found = reduce(DataFrame.union, parts)
    return _result(found, F.when(F.col("n") == 0, _absent(complete)).when(F.coalesce("require_unique", F.lit(True)) & (F.col("n") != 1), "underdetermined").otherwise("supported"), F.col("n"))


def texts_present(obligations: DataFrame, files: DataFrame) -> DataFrame:
    """Supported if the line of the file holds the quote; a file outside the tree can't be verified."""
    wanted = obligations.where("kind = 'source_text_present'")
    joined = wanted.join(files.select("path", "text"), "path", "left")
    held = F.contains(F.get(F.split("text", "\n"), (F.col("line") - 1).cast("int")), F.col("quote"))
    ok = F.col("text").isNotNull() & F.col("line").isNotNull() & (F.col("line") > 0) & (F.trim("quote") != "")
    return _result(joined, F.when(~F.coalesce(ok, F.lit(False)), "unverifiable").when(F.coalesce(held, F.lit(False)), "supported").otherwise("refuted"), F.coalesce(held, F.lit(False)).cast("int"))


def _expected(obligations: DataFrame, kind: str, files: DataFrame, *more: str) -> DataFrame:
    """Each distinct path that an obligation of the kind names, and whether the tree has it."""
    named = obligations.where(F.col("kind") == kind).select(*_KEYS, "kind", *more, F.explode_outer(F.array_distinct("paths")).alias("path"))
    return named.join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")


def paths_present(obligations: DataFrame, files: DataFrame, complete: bool) -> DataFrame:
    counted = _expected(obligations, "tree_paths_present", files).groupBy(*_KEYS, "kind").agg(F.count("path").alias("n"), F.count("there").alias("n_there"))
    return _result(counted, F.when(F.col("n") == 0, "unverifiable").when(F.col("n") == F.col("n_there"), "supported").otherwise(_absent(complete)), F.col("n_there"))


def _folders(path: Column) -> Column:
    """The empty prefix, every folder of a path, and the path itself."""
    parts = F.split(path, "/")
    return F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def paths_exact(obligations: DataFrame, files: DataFrame, complete: bool) -> DataFrame:
    """Supported if the tree under the prefix has the named paths and no other: counts per prefix, no sets are gathered. Too many paths refute even in an incomplete tree."""
    prefix = F.regexp_replace(F.trim(F.coalesce("prefix", F.lit(""))), "/$", "")
    named = _expected(obligations.withColumn("prefix", prefix), "tree_paths_exact", files, "prefix")
    inside = F.col("there") & ((F.col("prefix") == "") | (F.col("path") == F.col("prefix")) | F.startswith("path", F.concat(F.col("prefix"), F.lit("/"))))
    counted = named.groupBy(*_KEYS, "kind", "prefix").agg(F.count("path").alias("n"), F.count_if(inside).alias("n_met"))
    under = files.select("path").distinct().select(F.explode(_folders(F.col("path"))).alias("prefix")).join(counted.select("prefix").distinct(), "prefix", "left_semi").groupBy("prefix").agg(F.count(F.lit(1)).alias("n_under"))
    joined = counted.join(under, "prefix", "left").withColumn("n_under", F.coalesce("n_under", F.lit(0)))
    state = F.when(F.col("n") == 0, "unverifiable").when(F.col("n_under") > F.col("n_met"), "refuted").when(F.col("n") > F.col("n_met"), _absent(complete)).otherwise("supported")
    return _result(joined, state, F.col("n_met"))


def texts_absent(obligations: DataFrame, files: DataFrame, complete: bool) -> DataFrame:
    """Refuted by any needle in any named path; a path outside the tree can't be verified."""
    named = obligations.where("kind = 'tree_text_absent'").select(*_KEYS, "kind", F.array_distinct("needles").alias("needles"), F.explode_outer(F.array_distinct("paths")).alias("path"))
    joined = named.join(files.select("path", "text"), "path", "left")
    hits = F.size(F.filter("needles", lambda n: F.contains(F.col("text"), n)))
    counted = joined.groupBy(*_KEYS, "kind").agg(F.count_if(F.col("text").isNull() | (F.coalesce(F.size("needles"), F.lit(0)) < 1)).alias("n_lost"), F.sum(F.when(F.col("text").isNotNull(), hits)).alias("n_hits"))
    return _result(counted, F.when(F.col("n_lost") > 0, "unverifiable").when(F.col("n_hits") > 0, "refuted").otherwise("supported" if complete else "underdetermined"), F.coalesce("n_hits", F.lit(0)))


def checks_passed(obligations: DataFrame, runs: DataFrame) -> DataFrame:
    """Supported by exit code 0 with the attested output; a command that couldn't run, or wasn't, is unverifiable. A command that ran more than once must have passed each time."""
    merged = runs.groupBy("command").agg(F.bool_and((F.col("exit_code") == 0) & F.coalesce("matched", F.lit(True))).alias("passed"), F.bool_or(F.col("error").isNotNull()).alias("broken"))
    joined = obligations.where("kind = 'verification_check_passed'").join(merged, "command", "left")
    return _result(joined, F.when(F.coalesce("broken", F.lit(True)), "unverifiable").when(F.coalesce("passed", F.lit(False)), "supported").otherwise("refuted"), F.col("broken").isNotNull().cast("int"))


def evaluated(obligations: DataFrame, symbols: DataFrame, files: DataFrame, runs: DataFrame, complete_symbols: bool = True, complete_tree: bool = True) -> DataFrame:
    """Rows (claim_id, obligation_id, kind, state, n_evidence), one per obligation; an unknown kind is an error."""
    asked = written(obligations)
    if strange := asked.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))).select("kind").head(1):
        raise ValueError(f"unknown kind of obligation: {strange[0][0]}")
    questions = _result(asked.where("kind = 'open_question'"), F.lit("underdetermined"), F.lit(0))
    parts = (
        symbols_declared(asked, symbols, complete_symbols), texts_present(asked, files), paths_exact(asked, files, complete_tree), paths_present(asked, files, complete_tree), texts_absent(asked, files, complete_tree), checks_passed(asked, runs), questions,
    )
    return reduce(DataFrame.union, parts)


def adjudicated(results: DataFrame, claims: DataFrame) -> DataFrame:
    """Rows (claim_id, verdict, realization, n_results) of claims (claim_id, claim_kind): the gravest state decides; a claim without obligations is supported by nothing and underdetermined.

    A supported claim is implemented if a check that ran supports it, and partial if a declaration does.
    """
    tier = F.element_at(F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair]), F.col("kind"))
    has = lambda state: F.max(F.col("state") == state)
    supported = F.col("state") == "supported"
    counted = results.groupBy("claim_id").agg(
        F.when(has("refuted"), "refuted").when(has("unverifiable"), "unverifiable").when(has("underdetermined"), "underdetermined").otherwise("supported").alias("verdict"),
        F.max(supported & (tier == "executed")).alias("executed"), F.max(supported & (tier == "declared")).alias("declared"), F.count(F.lit(1)).alias("n_results"),
    )
    joined = claims.join(counted, "claim_id", "left")
    verdict, kind = F.coalesce("verdict", F.lit("underdetermined")), F.col("claim_kind")
    good, live = verdict == "supported", F.col("executed") | F.col("declared")
    realization = (
        F.when(verdict.isin("underdetermined", "unverifiable"), "unknown").when(kind == "proposed_design", F.when(good, "not_started").otherwise("diverged"))
        .when(kind == "historical_design", F.when(~good, "diverged").when(live, "unknown").otherwise("removed")).when(~good, F.when(kind == "accepted_design", "not_started").otherwise("diverged"))
        .when(F.col("executed"), "implemented").when(F.col("declared"), "partial").otherwise("unknown")
    )
    return joined.select("claim_id", verdict.alias("verdict"), realization.alias("realization"), F.coalesce("n_results", F.lit(0)).alias("n_results"))
