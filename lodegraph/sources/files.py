"""Folders of files and fact lines as tables; what is left out is counted, not hidden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders and file endings that are out of scope, with their category.
EXCLUDED_FOLDERS = {".git": "vcs", "__pycache__": "cache", "build": "build_artifact", "dist": "build_artifact", "node_modules": "vendored", "third_party": "vendored", "vendor": "vendored"}
EXCLUDED_ENDINGS = {".d.ts": "declaration", ".lock": "lock_file", ".map": "source_map", ".min.js": "minified"}
MOST_BYTES = 1 << 20

FACT = "kind string, repo string, file string, document_path string, line int"


def walk(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Rows (path, n_bytes, reason, content) of every file below `root`; content is null where a reason excludes it.

    Paths are relative; `ignored` are path prefixes. Content is read only for files that
    stay. Empty files hold nothing and are not listed.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root), "^[a-z0-9]+:/*|/+$", "")
    path = F.call_function("substring_index", F.col("path"), F.concat(F.regexp_replace(base, "^/*", ""), F.lit("/")), F.lit(-1))
    rows = found.select(path.alias("path"), F.col("length").alias("n_bytes"), "content")
    segments = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    folder = F.create_map(*[F.lit(x) for kv in EXCLUDED_FOLDERS.items() for x in kv])
    excluded = F.element_at(F.filter(F.transform(segments, lambda s: F.element_at(folder, s)), lambda c: c.isNotNull()), 1)
    reason = F.when(F.size(F.filter(segments, lambda s: s.isin(*EXCLUDED_FOLDERS))) > 0, excluded)
    for ending, category in EXCLUDED_ENDINGS.items():
        reason = reason.when(F.col("path").endswith(ending), category)
    for prefix in ignored:
        reason = reason.when((F.col("path") == prefix) | F.col("path").startswith(prefix.rstrip("/") + "/"), "ignored")
    reason = reason.when(F.col("n_bytes") > most_bytes, "too_large")
    marked = rows.withColumn("reason", reason)
    return marked.select("path", "n_bytes", "reason", F.when(F.col("reason").isNull(), F.col("content")).alias("content"))


def coverage(files: DataFrame) -> DataFrame:
    """Files and bytes by reason; those that stay have none."""
    return files.groupBy("reason").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"))


def components(files: DataFrame) -> DataFrame:
    """Files per first folder of the path."""
    return files.withColumn("component", F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise(".")).groupBy("component").agg(F.count(F.lit(1)).alias("n_files"))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Fact lines: the common fields as columns and the whole record as `data`; a line that isn't JSON has kind `unparsed`."""
    raw = spark.read.text(path).select(F.col("value").alias("data"))
    parsed = raw.withColumn("_f", F.from_json("data", FACT)).withColumn("_ok", F.try_parse_json("data").isNotNull())
    return parsed.select(F.when(F.col("_ok"), F.col("_f.kind")).otherwise("unparsed").alias("kind"), "_f.repo", "_f.file", "_f.document_path", "_f.line", "data")


def fact_key(columns: tuple[str, ...] = ("kind", "repo", "file")) -> Column:
    """The total order of facts: kind, repository, file, padded line, content."""
    return F.concat_ws("\u0000", *[F.coalesce(c, F.lit("")) for c in columns], F.lpad(F.coalesce("line", F.lit(0)).cast("string"), 9, "0"), "data")
