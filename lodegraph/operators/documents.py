"""Operators over texts: postings, sections, byte-bounded windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.runtime import ensure_importable

#: Bytes of text handled at once inside a Python task.
BATCH_BYTES = 4_000_000


def words(text: Column, pattern: str = "[a-z0-9_]{3,}") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """Rows (key, term, n): each distinct term of a document once, with its occurrences; with `only` (term), just those terms."""
    said = docs.select(key, F.explode(words(F.col(text))).alias("term"))
    said = said if only is None else said.join(only, "term", "left_semi")
    return said.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def document_frequency(posted: DataFrame, n_docs: int, share: float = 0.05, least: int = 20) -> DataFrame:
    """Rows (term, df, ambient); a term is ambient when more than max(least, ceil(share * documents)) documents hold it."""
    counted = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counted.withColumn("ambient", F.col("df") > F.lit(max(least, -int(-n_docs * share // 1))))


def hit_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n <= 5, "1-5").when(n <= 25, "6-25").when(n <= 100, "26-100").otherwise(">100")


def numbered_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, line, content), lines from 1."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("pos", "content")).select(key, (F.col("pos") + 1).alias("line"), "content")


def sections(lines: DataFrame, level: Column, levels: int, key: str = "doc_id") -> DataFrame:
    """Rows (key, line, level, line_end) per heading: a section ends before the next heading of its level or above.

    `level` is null on lines that aren't headings. Lines inside fences never are.
    """
    ordered = Window.partitionBy(key).orderBy("line")
    fence = F.col("content").rlike("^\\s*(```|~~~)")
    inside = F.sum(F.when(fence, 1).otherwise(0)).over(ordered) % 2 == 1
    marked = lines.withColumn("level", F.when(~inside & ~fence, level)).withColumn("last", F.max("line").over(Window.partitionBy(key)))
    after = Window.partitionBy(key).orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)  # a running minimum from the end
    nexts = [F.min(F.when(F.col("level") <= k, F.col("line"))).over(after) for k in range(1, levels + 1)]
    following = F.element_at(F.array(*nexts), F.col("level"))
    return marked.withColumn("line_end", F.when(F.col("level").isNotNull(), F.coalesce(following - 1, F.col("last")))).where("level IS NOT NULL").select(key, "line", F.col("level").cast("int").alias("level"), F.col("line_end").cast("int").alias("line_end"))


def byte_windows(docs: DataFrame, most: int, overlap: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, window, line, line_end, context_line, n_bytes): whole lines packed greedily to `most` bytes.

    Windows partition a document's lines; a line above the bound is alone. The context of a window
    is the run of whole lines before it that first reaches `overlap` bytes.
    """
    ensure_importable(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, step) for whole in batches for step in [max(1, int(whole.num_rows * BATCH_BYTES / max(whole.nbytes, 1)))] for at in range(0, whole.num_rows, step)):
            rows: list[tuple] = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sizes = [len(x.encode("utf-8", "surrogatepass")) + 1 for x in (value or "").split("\n")]
                start, held, number = 0, 0, 0
                for i, size in enumerate([*sizes, most + 1]):
                    if i > start and (held + size > most or i == len(sizes)):
                        back, context = start, 0
                        while overlap and number and back and context < overlap:
                            back -= 1
                            context += sizes[back]
                        rows.append((doc, number, start + 1, i, back + 1, held))
                        start, held, number = i, 0, number + 1
                    held += size
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=[key, "window", "line", "line_end", "context_line", "n_bytes"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(pack, f"`{key}` {kind}, window long, line long, line_end long, context_line long, n_bytes long")
