"""Line deduplication by range-partitioned line hashes and per-document keep bitmaps.

Lines become 128-bit keys, written once. The keys are range-partitioned by (key, document) and sorted by
position inside each range, so a key that a third of all documents hold is spread over ranges
by document. One streaming window pass keeps each document's first occurrence of a key; those
firsts are counted per key with map-side combining. Positions of frequent keys come back as
bitmaps of 64-line words; a word that keeps all its lines is not stored. The frequent keys are
broadcast where a count proves them few; else they are joined with a salt per document. Text is never shuffled
by line, and only DataFrame functions are used.

Defined cases: a null or empty text is one empty line; very long texts are split whole; rows that repeat a doc_id count as one
document but keep their own lines; a null doc_id counts as one document; an empty table gives
an empty result; further columns are ignored by `keep_bitmaps` and carried by `drop_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.llm.common import text_key
from lodegraph.runtime import BROADCAST_ROWS, checkpoint, written

STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = 64
#: Parts that each frequent key is spread over where there are too many of them to broadcast.
SALTS = 16


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(STRIPPED)), UPPER, LOWER)


def hashed_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """One row per line: doc_id, row_key, pos, and the key's 128 bits h1, h2."""
    key = F.col("key")
    return (
        docs.select(F.col("doc_id"), text_key(F.col("text")).alias("row_key"), F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("pos", "key"))
        .where(F.length(key) >= min_chars)
        .select("doc_id", "row_key", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))
    )


def frequent_keys(lines: DataFrame, min_docs: int = 10, partitions: int | None = None) -> DataFrame:
    """Of hashed lines, the keys (h1, h2) that at least `min_docs` documents hold, with their document count."""
    keys = ("h1", "h2", "doc_id")
    hashed = lines.select(*keys, "row_key", "pos")
    ranged = hashed.repartitionByRange(partitions, *keys) if partitions else hashed.repartitionByRange(*keys)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("row_key", "pos"))
    firsts = ranged.withColumn("nth", nth).where("nth = 1")
    return firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, partitions: int | None = None) -> DataFrame:
    """One row per document that loses a line: doc_id, row_key, n_dropped, words.

    `words` holds (word, bits) for each run of 64 lines that loses at least one; bit i set means
    line 64 * word + i stays.
    """
    lines = written(hashed_lines(docs, min_chars))
    frequent = checkpoint(frequent_keys(lines, min_docs, partitions).select("h1", "h2"))
    if len(frequent.head(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS:
        lost = lines.join(F.broadcast(frequent), ["h1", "h2"], "left_semi")
    else:
        spread = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        lost = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(SALTS)).cast("int")).join(spread, ["h1", "h2", "salt"], "left_semi")
    bit = F.expr(f"shiftleft(1L, cast(pos % {WORD} as int))")
    words = lost.groupBy("doc_id", "row_key", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(F.bit_or(bit).alias("gone"))
    return words.groupBy("doc_id", "row_key").agg(
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("words"),
    )


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, partitions: int | None = None) -> DataFrame:
    """`docs` with kept_text, n_lines and n_dropped; other columns pass through."""
    taken = {c.lower() for c in docs.columns} & {"kept_text", "n_lines", "n_dropped"}
    docs = docs.drop(*taken)
    maps = keep_bitmaps(docs, min_docs, min_chars, partitions).select(
        F.col("doc_id").alias("_doc"), F.col("row_key").alias("_row"), F.col("n_dropped").alias("_lost"), F.map_from_entries("words").alias("_words")
    )
    joined = docs.join(maps, docs["doc_id"].eqNullSafe(F.col("_doc")) & (text_key(docs["text"]) == F.col("_row")), "left")
    split = joined.withColumn("_lines", lines_of(F.col("text")))
    dense = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / WORD).cast("int")), lambda w: F.coalesce(F.element_at("_words", w), F.lit(-1).cast("long"))
    )
    split = split.withColumn("_dense", F.when(F.col("_lost").isNotNull(), dense))
    kept = F.expr(f"filter(_lines, (l, i) -> (shiftright(element_at(_dense, cast(i div {WORD} as int) + 1), cast(i % {WORD} as int)) & 1L) = 1L)")
    return split.select(
        *docs.columns,
        F.when(F.col("_lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce("_lost", F.lit(0)).cast("long").alias("n_dropped"),
    )
