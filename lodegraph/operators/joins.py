"""Resolution joins: every reference gets a status by how many targets it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def candidates(targets: DataFrame, target: str, target_key: str, most: int = 25) -> DataFrame:
    """Rows (_key, n_candidates, _first): per key the count of distinct targets and the first `most`, ranked before they are collected."""
    pairs = targets.where(F.col(target_key).isNotNull()).select(F.col(target_key).alias("_key"), F.col(target).alias("_target")).distinct()
    counted = pairs.groupBy("_key").agg(F.count(F.lit(1)).alias("n_candidates"))
    ranked = pairs.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy("_target"))).where(F.col("_nth") <= most)
    return ranked.groupBy("_key").agg(F.array_sort(F.collect_list("_target")).alias("_first")).join(counted, "_key")


def resolve(refs: DataFrame, targets: DataFrame, ref_id: str, key: str, target: str, target_key: str, most: int = 25) -> DataFrame:
    """Rows (ref_id, status, target, n_candidates, candidates): unresolved, resolved or ambiguous.

    Targets are grouped by key before the join, so a key that very many references hold isn't
    multiplied by its targets. The count holds all; the list holds the first `most`.
    """
    listed = candidates(targets, target, target_key, most)
    joined = refs.join(listed, F.col(key) == F.col("_key"), "left")
    n = F.coalesce("n_candidates", F.lit(0))
    return joined.select(
        ref_id,
        F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous").alias("status"),
        F.when(n == 1, F.col("_first")[0]).alias("target"),
        n.alias("n_candidates"),
        F.when(n > 1, F.col("_first")).alias("candidates"),
    )


def longest_tail(refs: DataFrame, targets: DataFrame, ref_id: str, path: str, target: str, target_path: str, separator: str = "/") -> DataFrame:
    """Targets whose path is the longest tail of the reference's path: an equi-join on every tail, not a theta join."""
    parts = F.split(F.col(path), separator)
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), separator))
    exploded = refs.select(ref_id, F.posexplode(tails).alias("_from", "_tail"))
    joined = exploded.join(targets.select(F.col(target_path).alias("_tail"), F.col(target).alias("target")), "_tail")
    best = joined.withColumn("_best", F.min("_from").over(Window.partitionBy(ref_id)))
    return best.where("_from = _best").select(ref_id, "target", F.col("_tail").alias("tail"))


def prefix_matches(names: DataFrame, prefixes: DataFrame, name: str, prefix: str) -> DataFrame:
    """Names that a wildcard prefix matches: an equi-join on every prefix of the name up to the longest one in use."""
    most = prefixes.agg(F.max(F.length(prefix)).alias("n")).first()["n"] or 0
    cut = F.transform(F.sequence(F.lit(0), F.least(F.length(name), F.lit(most))), lambda n: F.substring(F.col(name), F.lit(1), n))
    return names.withColumn("_prefix", F.explode(cut)).join(prefixes.select(F.col(prefix).alias("_prefix")).distinct(), "_prefix").withColumnRenamed("_prefix", "prefix")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Pairs whose closed integer intervals overlap, within equal keys.

    Intervals are cut into cells of `width`; cells are an equi-join key, so neither side is scanned per
    row of the other, and a pair is kept in the first cell both have.
    """
    def cells(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        return df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(ends[0]) / width), F.floor(F.col(ends[1]) / width))))

    joined = cells(left, a).join(cells(right, b), [*keys, "_cell"])
    hit = (F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1]))
    first = F.col("_cell") == F.greatest(F.floor(F.col(a[0]) / width), F.floor(F.col(b[0]) / width))
    return joined.where(hit & first).drop("_cell")


def first_by(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")
