"""Graphs on disk: nodes and edges as Parquet with a manifest that reading verifies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def record_digest(df: DataFrame) -> DataFrame:
    """The rows with record_digest: a hash of all columns in name order, nulls included."""
    ordered = sorted(c for c in df.columns if c != "record_digest")
    return df.withColumn("record_digest", F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (n, digest) that doesn't depend on row order; repeated rows count."""
    hashed = record_digest(df).select(F.xxhash64("record_digest").alias("a"), F.xxhash64("record_digest", F.lit(1)).alias("b"))
    return hashed.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(":", F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))), 256).alias("digest"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write both tables, then the manifest; a folder without a manifest is unfinished."""
    spark = nodes.sparkSession
    manifest = None
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.parquet(f"{path}/{name}")
        row = fingerprint(spark.read.parquet(f"{path}/{name}")).select(F.lit(name).alias("name"), "n", "digest")
        manifest = row if manifest is None else manifest.union(row)
    manifest.coalesce(1).write.json(f"{path}/manifest")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, after both have been held against the manifest."""
    expected = {r["name"]: (r["n"], r["digest"]) for r in spark.read.schema("name string, n long, digest string").json(f"{path}/manifest").collect()}
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges")}
    for name, df in tables.items():
        if tuple(fingerprint(df).first()) != expected.get(name):
            raise ValueError(f"{name} at {path} doesn't match its manifest")
    return tables["nodes"], tables["edges"]
