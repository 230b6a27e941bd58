"""A table as one canonical JSON text: the same bytes and the same digest however it was partitioned.

Rows are objects with their keys in order, sorted by their own text, in a JSON array of two-space indentation. The sort is by range, so no task holds the
table, and ends with a line end; each part knows the byte at which it begins. The digest is of two levels: of every `CHUNK` rows in order, and of those digests in order, so it is computed in parallel as well.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType
from pyspark.sql.window import Window

from lodegraph.runtime import written

#: Rows whose digest is computed together.
CHUNK = 4096
OPEN, JOIN, CLOSE, EMPTY = "[\n", ",\n", "\n]\n", "[]\n"


def value_text(column: Column, kind: DataType, depth: int = 0) -> Column:
    """A value as JSON with the keys of objects in order and each member and element on a line of its own; a null is `null`, and empty objects and arrays stand on their line."""
    inner, outer = F.lit("\n" + "  " * (depth + 1)), F.lit("\n" + "  " * depth)
    comma = F.concat(F.lit(","), inner)

    def block(left: str, parts: Column, right: str) -> Column:
        return F.when(F.size(parts) == 0, left + right).otherwise(F.concat(F.lit(left), inner, F.array_join(parts, ",\n" + "  " * (depth + 1)), outer, F.lit(right)))

    if isinstance(kind, StructType):
        members = [F.concat(F.lit(f'{json.dumps(f.name, ensure_ascii=False)}: '), value_text(column[f.name], f.dataType, depth + 1)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), inner, *[x for i, m in enumerate(members) for x in ((comma, m) if i else (m,))], outer, F.lit("}")) if members else F.lit("{}")
    elif isinstance(kind, ArrayType):
        text = block("[", F.transform(column, lambda x: value_text(x, kind.elementType, depth + 1)), "]")
    elif isinstance(kind, MapType):
        keys = F.array_sort(F.map_keys(column))
        text = block("{", F.transform(keys, lambda k: F.concat(value_text(k.cast("string"), StringType()), F.lit(": "), value_text(column[k], kind.valueType, depth + 1))), "}")
    else:
        text = F.to_json(F.struct(column.alias("v")))
        text = F.substring(text, F.lit(6), F.length(text) - 6)
    return F.when(column.isNull(), "null").otherwise(text)


def record_text(df: DataFrame) -> DataFrame:
    """Rows (text): each row as an object one level in, its keys in order; nulls are written."""
    row = F.struct(*[F.col(f"`{f.name}`") for f in df.schema.fields])
    return df.select(row.alias("_row")).select(F.concat(F.lit("  "), value_text(F.col("_row"), df.schema, 1)).alias("text"))


def canonical_rows(df: DataFrame) -> DataFrame:
    """Rows (rank, start, n_bytes, text): each record's text, its place from 0 and the byte at which it begins in the whole.

    Only the count and bytes of each partition of the sorted table are brought together, one row each; equal records are interchangeable.
    """
    sized = record_text(df).withColumn("n_bytes", F.octet_length("text").cast("long"))
    at = sized.repartitionByRange("text").sortWithinPartitions("text").withColumn("_at", F.monotonically_increasing_id())
    held = written(at)
    part = F.shiftright("_at", 33)
    parts = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.col("n_bytes") + len(JOIN)).alias("_bytes")).orderBy("_part").collect()  # as many as partitions
    spark, rows, size, offsets = df.sparkSession, 0, len(OPEN), []
    for p in parts:
        offsets.append((p["_part"], rows, size))
        rows, size = rows + p["_rows"], size + p["_bytes"]
    begun = spark.createDataFrame(offsets, "_part long, _rank long, _start long")
    joined = held.withColumn("_part", part).join(F.broadcast(begun), "_part")
    within = joined.select("_part", "_at", "_rank", "_start", "n_bytes", "text", (F.col("n_bytes") + len(JOIN)).alias("_size"))
    return _running(within).select((F.col("_rank") + F.col("_nth")).alias("rank"), (F.col("_start") + F.col("_before")).alias("start"), "n_bytes", "text")


def _running(rows: DataFrame) -> DataFrame:
    """`_nth` and `_before`, the rows and bytes of a part before each row: the part's own order numbers its rows, and sums run over blocks of them."""
    nth = rows.withColumn("_nth", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).withColumn("_block", F.floor(F.col("_nth") / CHUNK))
    sums = nth.groupBy("_part", "_block").agg(F.sum("_size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("_part").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_part", "_block", before.alias("_upto"))
    own = F.coalesce(F.sum("_size").over(Window.partitionBy("_part", "_block").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return nth.withColumn("_own", own).join(starts, ["_part", "_block"]).withColumn("_before", F.col("_upto") + F.col("_own"))


def canonical_digest(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row (n, n_bytes, digest): records, bytes of the whole text, and the digest of the digests of its chunks of records in order.

    A chunk's texts come together in one group of bounded rows; chunk digests are grouped again until one is left.
    """
    rows = canonical_rows(df)
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.col("start") + F.col("n_bytes")) + len(CLOSE), F.lit(len(EMPTY))).alias("n_bytes"))
    level = rows.select("rank", "text")
    joined = lambda text, order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]), JOIN), 256)
    while True:
        level = written(level.groupBy(F.floor(F.col("rank") / chunk).cast("long").alias("rank2")).agg(joined("text", "rank").alias("text")).withColumnRenamed("rank2", "rank"))
        if len(level.head(2)) < 2:
            break
    top = level.agg(F.coalesce(F.max("text"), F.sha2(F.lit(""), 256)).alias("digest"))
    return totals.join(top, how="cross")  # one row with one row


def write_canonical(df: DataFrame, path: str, part_bytes: int = 32_000_000) -> DataFrame:
    """Writes the text as files whose concatenation by name is the canonical array; returns their manifest (part, start, n_bytes, n_rows).

    Parts are cut by the rows' own bytes, so they too are the same for any partitioning of the input.
    """
    rows = canonical_rows(df)
    sized = rows.select("rank", "start", "text", F.floor(F.col("start") / part_bytes).cast("long").alias("part"))
    last = rows.agg(F.max("rank").alias("m")).first()["m"]
    if last is None:
        df.sparkSession.createDataFrame([(EMPTY.rstrip(),)], "value string").coalesce(1).write.text(f"{path}/part=0")
        return df.sparkSession.createDataFrame([(0, 0, len(EMPTY), 0)], "part long, start long, n_bytes long, n_rows long")
    lead, tail = F.when(F.col("rank") == 0, OPEN).otherwise(""), F.when(F.col("rank") == last, CLOSE.rstrip()).otherwise(JOIN.rstrip())
    made = sized.select("part", "rank", "start", F.concat(lead, F.col("text"), tail).alias("value"))  # the writer ends each value's line
    made.repartition("part").sortWithinPartitions("part", "rank").select("part", "value").write.partitionBy("part").text(path)
    manifest = made.groupBy("part").agg(F.min("rank").alias("_first"), F.min("start").alias("_start"), F.sum(F.octet_length("value") + 1).alias("n_bytes"), F.count(F.lit(1)).alias("n_rows"))
    return manifest.select("part", F.when(F.col("_first") == 0, F.lit(0)).otherwise(F.col("_start")).alias("start"), "n_bytes", "n_rows")


def read_canonical(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a canonical text again; a record that doesn't fit the schema is an error."""
    lines = spark.read.text(path, wholetext=True)
    body = F.concat(F.lit("["), F.regexp_replace(F.regexp_replace("value", r"^\[\n", ""), r"(,\n|\n\]\n)$", ""), F.lit("]"))
    body = F.when(F.col("value") == EMPTY, "[]").otherwise(body)
    return lines.select(F.explode(F.from_json(body, f"array<struct<{schema}>>", {"mode": "FAILFAST"})).alias("r")).select("r.*")
