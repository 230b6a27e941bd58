"""Records: JSON leaves and their addresses, identities, evidence of several families in one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.runtime import checkpoint


def leaves(df: DataFrame, key: str, json: str) -> DataFrame:
    """Rows (key, path, value): every scalar of a JSON text with its dotted path; array elements share their array's path.

    One variant level is exploded at a time, for all rows together, until no value is nested; text that isn't JSON has no leaf.
    """
    spark = df.sparkSession
    level = df.select(F.col(key).alias("_k"), F.lit("").alias("path"), F.try_parse_json(json).alias("value")).where("value IS NOT NULL")
    found = None
    while True:
        level = checkpoint(level)
        kind = F.schema_of_variant("value")
        nested = kind.rlike("^(OBJECT|ARRAY)")
        part = level.where(~nested).select("_k", "path", F.col("value").cast("string").alias("value"))
        found = part if found is None else found.union(part)
        inner = level.where(nested)
        if inner.isEmpty():
            break
        level = spark.sql("SELECT _k, CASE WHEN v.key IS NULL THEN path || '[]' WHEN path = '' THEN v.key ELSE path || '.' || v.key END AS path, v.value FROM {inner}, LATERAL variant_explode(value) AS v", inner=inner)
    return found.withColumnRenamed("_k", key)


def addressed(found: DataFrame, key: str) -> DataFrame:
    """Leaves with ordinal (from 1, by value) and multiplicity among those of the same record and path."""
    same = Window.partitionBy(key, "path")
    return found.withColumn("ordinal", F.row_number().over(same.orderBy("value"))).withColumn("multiplicity", F.count(F.lit(1)).over(same))


def storage_ids(edges: DataFrame, identity: Column, content: Column) -> DataFrame:
    """`edges` with storage_id: the id where it is the only one, else id#digest#ordinal among rows of equal content."""
    digest = F.substring(F.sha2(content, 256), 1, 16)
    counted = edges.withColumn("_id", identity).withColumn("_digest", digest).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_id")))
    nth = F.row_number().over(Window.partitionBy("_id", "_digest").orderBy("_digest"))
    return counted.withColumn("storage_id", F.when(F.col("_n") == 1, F.col("_id")).otherwise(F.concat_ws("#", "_id", "_digest", nth.cast("string")))).drop("_id", "_digest", "_n")


def identity(*parts: Column) -> Column:
    """A digest of parts, each with its length before it, so that no two part lists run together; null differs from empty."""
    framed = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("|", *framed), 256)


#: Evidence classes, the first that holds decides.
EVIDENCE = ("refusal", "interpretation", "derived", "inferred", "extracted")


def evidence_class(refused: Column, interpreted: Column, derived: Column, inferred: Column) -> Column:
    out = F.when(F.coalesce(refused, F.lit(False)), EVIDENCE[0])
    for name, test in zip(EVIDENCE[1:4], (interpreted, derived, inferred), strict=True):
        out = out.when(F.coalesce(test, F.lit(False)), name)
    return out.otherwise(EVIDENCE[4])


def evidence(families: dict[str, tuple[DataFrame, Column, Column, Column]]) -> DataFrame:
    """Rows (evidence_id, family, class, subject, value) of record families: name -> (rows, subject, class, value)."""
    out = None
    for family, (rows, subject, kind, value) in families.items():
        part = rows.select(F.lit(family).alias("family"), kind.alias("class"), subject.cast("string").alias("subject"), value.cast("string").alias("value"))
        part = part.select(identity(F.col("family"), F.col("subject"), F.col("value")).alias("evidence_id"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def reduced(claims: DataFrame, key: str, identifier: str, support: str, source: str) -> DataFrame:
    """Per proposition: its canonical claim (the least id), claims, distinct supports and sources; counts, not lists, so no group is gathered."""
    return claims.groupBy(key).agg(F.min(identifier).alias("canonical"), F.count(F.lit(1)).alias("n_claims"), F.countDistinct(support).alias("n_supports"), F.countDistinct(source).alias("n_sources"))


def conserved(proposed: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Rows (state, n): proposals settled once, more than once, or not at all, and outcomes that nothing proposed."""
    counts = outcomes.groupBy(key).agg(F.count(F.lit(1)).alias("n_outcomes"))
    joined = proposed.select(key).distinct().withColumn("proposed", F.lit(True)).join(counts, key, "full")
    state = F.when(F.col("proposed").isNull(), "unproposed").when(F.col("n_outcomes").isNull(), "lost").when(F.col("n_outcomes") > 1, "repeated").otherwise("settled")
    return joined.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
