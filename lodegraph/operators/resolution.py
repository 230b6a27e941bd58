"""Resolution joins beyond plain keys: exact then tail, dotted heads, scopes, route templates, token overlap, containers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.functions.text import slug, tokens
from lodegraph.operators.joins import longest_tail, overlapping


def exact_then_tail(refs: DataFrame, targets: DataFrame, ref_id: str, path: str, target: str, target_path: str, separator: str = "/") -> DataFrame:
    """Rows (ref_id, target, basis): targets of the very path, else, for references without one, those with the longest tail of it."""
    known = targets.select(F.col(target_path).alias("_path"), F.col(target).alias("target"))
    exact = refs.join(known, F.col(path) == F.col("_path")).select(ref_id, "target", F.lit("exact").alias("basis"))
    left = refs.join(known.select("_path").distinct(), F.col(path) == F.col("_path"), "left_anti")
    return exact.union(longest_tail(left, targets, ref_id, path, target, target_path, separator).select(ref_id, "target", F.lit("tail").alias("basis")))


def longest_head(refs: DataFrame, targets: DataFrame, ref_id: str, name: str, target: str, target_name: str, separator: str = ".") -> DataFrame:
    """Rows (ref_id, target, dropped): the targets that name the longest leading part of a dotted name; dropped parts are attributes."""
    parts = F.split(F.col(name), "[" + separator + "]")
    heads = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), separator))
    exploded = refs.where(F.col(name) != "").select(ref_id, F.posexplode(heads).alias("dropped", "_head"))
    joined = exploded.join(targets.select(F.col(target_name).alias("_head"), F.col(target).alias("target")), "_head")
    best = joined.withColumn("_least", F.min("dropped").over(Window.partitionBy(ref_id)))
    return best.where("dropped = _least").select(ref_id, "target", "dropped")


def in_scope(refs: DataFrame, targets: DataFrame, ref_id: str, key: str, scopes: str, target: str, target_key: str, target_scope: str) -> DataFrame:
    """Rows (ref_id, status, target, n_candidates): names looked up in the scopes (an array) that a reference can see.

    References that ask for one name in the same scopes are answered once. A target that lies in one scope of its name is counted with its
    cell before anything is joined; only targets in several scopes, which could be met twice, are counted by distinct pairs.
    """
    asked = refs.select(ref_id, F.col(key).alias("_key"), F.array_sort(F.filter(F.array_distinct(scopes), lambda s: s.isNotNull())).alias("_scopes"))
    classes = asked.select("_key", "_scopes").distinct()
    seen = classes.select("_key", "_scopes", F.explode("_scopes").alias("_scope"))
    pairs = targets.select(F.col(target_key).alias("_key"), F.col(target_scope).alias("_scope"), F.col(target).alias("_target")).where("_key IS NOT NULL AND _scope IS NOT NULL AND _target IS NOT NULL").distinct()
    placed = pairs.groupBy("_key", "_target").agg(F.collect_set("_scope").alias("_in"))
    cells = placed.where(F.size("_in") == 1).groupBy("_key", F.col("_in")[0].alias("_scope")).agg(F.count(F.lit(1)).alias("n"), F.min("_target").alias("first"))
    once = seen.join(cells, ["_key", "_scope"]).select("_key", "_scopes", "n", "first")
    several = placed.where(F.size("_in") > 1).select("_key", F.explode("_in").alias("_scope"), "_target")
    again = seen.join(several, ["_key", "_scope"]).select("_key", "_scopes", "_target").distinct().groupBy("_key", "_scopes").agg(F.count(F.lit(1)).alias("n"), F.min("_target").alias("first"))
    counted = once.union(again).groupBy("_key", "_scopes").agg(F.sum("n").alias("n_candidates"), F.min("first").alias("_first"))
    n = F.coalesce("n_candidates", F.lit(0))
    joined = asked.join(counted, ["_key", "_scopes"], "left")
    return joined.select(ref_id, F.when(n == 0, "external").when(n == 1, "resolved").otherwise("ambiguous").alias("status"), F.when(n == 1, F.col("_first")).alias("target"), n.alias("n_candidates"))


_PARAMETER = r"^(?::.*|\{.*\}|<.*>|\*)$"


def _segments(path: str):
    return F.filter(F.split(F.col(path), "/"), lambda s: s != "")


def route_matches(clients: DataFrame, routes: DataFrame) -> DataFrame:
    """Rows (client_id, route_id, score) of clients (client_id, repo, method, host, path, test) and routes (route_id, repo, method, host, template).

    Templates become keys by masking their parameters; a client's path is masked in each way that
    routes of its length are, so matching is an equi-join. Only routes of other repositories
    match, of the client's method where it states one. A client with a host keeps its best-scoring
    routes: 3 for the declared host, 2 for the repository's slug in it, 1 for a shared token; a client
    without one matches only in tests. The best score is found by its own equi-join on host and key, and only clients
    without it meet the routes of all hosts.
    """
    parts = _segments("template")
    masked = F.transform(parts, lambda s: F.when(s.rlike(_PARAMETER), F.lit("*")).otherwise(s))
    keyed = routes.select("route_id", F.col("repo").alias("r_repo"), F.col("method").alias("r_method"), F.col("host").alias("r_host"), F.array_join(masked, "/").alias("_key"), F.size(parts).alias("_n"), F.transform(masked, lambda s: s == "*").alias("_mask"))
    masks = keyed.select("_n", "_mask").distinct()
    ways = clients.withColumn("_parts", _segments("path")).withColumn("_n", F.size("_parts")).join(masks, "_n")
    own = F.array_join(F.zip_with("_parts", "_mask", lambda s, m: F.when(m, F.lit("*")).otherwise(s)), "/")
    ways, keyed = ways.withColumn("_key", own), keyed.drop("_n", "_mask")
    allowed = (F.col("repo") != F.col("r_repo")) & (F.col("method").isNull() | (F.lower("method") == F.lower("r_method")))
    same = ways.join(keyed.withColumn("host", F.col("r_host")), ["_key", "host"]).where(allowed).select("client_id", "route_id", F.lit(3).alias("score")).distinct()
    left = ways.where(F.col("host").isNotNull() | F.col("test")).join(same.select("client_id"), "client_id", "left_anti")
    joined = left.join(keyed, "_key").where(allowed)
    words = lambda c: tokens(F.regexp_replace(c, "[^A-Za-z0-9]+", " "))
    score = F.when(F.col("host") == F.col("r_host"), 3).when(F.contains(slug(F.col("host")), slug(F.col("r_repo"))), 2).when(F.arrays_overlap(words(F.col("host")), words(F.col("r_repo"))), 1).otherwise(0)
    scored = joined.withColumn("score", F.when(F.col("host").isNull(), 0).otherwise(score)).where((F.col("score") > 0) | (F.col("host").isNull() & F.col("test")))
    best = scored.withColumn("_best", F.max("score").over(Window.partitionBy("client_id")))
    return same.union(best.where("score = _best").select("client_id", "route_id", "score").distinct())


def token_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, name: str, other: str) -> DataFrame:
    """Rows (left_id, right_id, n_shared): names that share a distinctive word; one row per pair, counted before it is joined on."""
    one = left.select(left_id, F.explode(tokens(F.col(name))).alias("_word"))
    two = right.select(right_id, F.explode(tokens(F.col(other))).alias("_word"))
    return one.join(two, "_word").groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("n_shared"))


def deepest_container(facts: DataFrame, sections: DataFrame, key: str, fact_id: str, width: int = 64) -> DataFrame:
    """Rows (fact_id, line, level): for each fact (key, fact_id, at) the deepest, then last, section (key, line, line_end, level) that holds its line."""
    spans = sections.select(key, F.col("line").alias("_low"), F.col("line_end").alias("_high"), F.col("level").alias("_level"))
    points = facts.select(key, fact_id, F.col("at").alias("_at"), F.col("at").alias("_same"))
    held = overlapping(points, spans, [key], ("_at", "_same"), ("_low", "_high"), width)
    best = held.groupBy(key, fact_id).agg(F.max(F.struct("_level", "_low")).alias("b"))
    joined = facts.select(key, fact_id).join(best, [key, fact_id], "left")
    return joined.select(key, fact_id, F.col("b._low").alias("line"), F.col("b._level").alias("level"))
