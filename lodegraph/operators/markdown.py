"""Markdown as rows: headings, blocks with byte offsets, ancestry. Everything is a window over numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = 6
_ATX = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$"
_FENCE = r"^ {0,3}(?:```|~~~)"


def marked_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines (key, line, content) with start (bytes before it), fenced (inside or at a fence), level and title of headings.

    A setext heading is a line of text with a line of `=` or `-` under it; nothing inside fences is a heading.
    """
    ordered = Window.partitionBy(key).orderBy("line")
    fence = F.col("content").rlike(_FENCE)
    before = F.coalesce(F.sum(F.octet_length("content") + 1).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parity = F.sum(F.when(fence, 1).otherwise(0)).over(ordered) % 2
    wide = lines.withColumn("start", before).withColumn("fence", fence).withColumn("fenced", fence | (parity == 1)).withColumn("under", F.lead("content").over(ordered)).withColumn("above", F.lag("content").over(ordered))
    atx = ~F.col("fenced") & F.col("content").rlike(_ATX)
    text = (F.trim("content") != "") & ~F.col("content").rlike(r"^ {0,3}(?:[#>|*+-]|[0-9]+[.)])") & ~F.col("fenced")
    setext = text & F.coalesce(F.col("under").rlike(r"^ {0,3}(?:=+|-+)[ \t]*$"), F.lit(False))
    level = F.when(atx, F.length(F.regexp_extract("content", _ATX, 1))).when(setext, F.when(F.col("under").rlike("="), 1).otherwise(2))
    title = F.when(atx, F.regexp_extract("content", _ATX, 2)).when(setext, F.trim("content"))
    return wide.select(key, "line", "content", "start", "fence", "fenced", level.alias("level"), title.alias("title"))


def headings(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, line, level, title, path): each heading, and the titles that enclose it and its own, joined by " / "."""
    found = marked_lines(lines, key).where("level IS NOT NULL").select(key, "line", "level", "title")
    upto = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("level") == k, F.struct("line", "title"))).over(upto).alias(f"_{k}") for k in range(1, LEVELS + 1)]
    above = [F.max(F.when(F.col("level") < k, F.col("line"))).over(upto).alias(f"_above{k}") for k in range(1, LEVELS + 1)]
    wide = found.select(key, "line", "level", "title", *last, *above)
    held = [F.when((F.lit(k) <= F.col("level")) & (F.col(f"_{k}.line") > F.coalesce(F.col(f"_above{k}"), F.lit(0))), F.col(f"_{k}.title")) for k in range(1, LEVELS + 1)]
    path = F.array_join(F.filter(F.array(*held), lambda t: t.isNotNull()), " / ")
    return wide.select(key, "line", F.col("level").cast("int").alias("level"), "title", path.alias("path"))


def block_kind() -> Column:
    line = F.col("content")
    return (
        F.when(F.col("fenced"), "fence").when(F.col("level").isNotNull(), "heading").when(F.trim(line) == "", "blank").when(line.rlike(r"^ {0,3}(?:[*+-]|[0-9]+[.)])[ \t]"), "list")
        .when(line.rlike(r"^ {0,3}>"), "quote").when(line.rlike(r"^ {0,3}\|.*\|[ \t]*$"), "table").otherwise("paragraph")
    )


def blocks(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, block, kind, line, line_end, start, n_bytes): runs of lines of one kind; they partition the text.

    A fence is one block from its opening to its closing line; each heading is a block of its own.
    """
    ordered = Window.partitionBy(key).orderBy("line")
    kinds = marked_lines(lines, key).withColumn("kind", block_kind()).withColumn("_opens", F.col("fence") & (F.sum(F.when(F.col("fence"), 1).otherwise(0)).over(ordered) % 2 == 1))
    fresh = (F.col("kind") != F.lag("kind").over(ordered)) | F.lag("kind").over(ordered).isNull() | (F.col("kind") == "heading") | F.col("_opens")
    numbered = kinds.withColumn("block", F.sum(F.when(fresh, 1).otherwise(0)).over(ordered) - 1)
    return numbered.groupBy(key, "block").agg(F.min("kind").alias("kind"), F.min("line").alias("line"), F.max("line").alias("line_end"), F.min("start").alias("start"), F.sum(F.octet_length("content") + 1).alias("n_bytes"))
