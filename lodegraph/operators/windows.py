"""Windows of texts and tiles of scopes under byte budgets: ordered rows packed in one pass, with exact totals of what is left out.

The fold over ordered rows streams: rows of a group come sorted, and the state is one running size, whatever the group holds. What a window consists of is then found by
counts and sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.operators import markdown
from lodegraph.operators.documents import BATCH_BYTES, numbered_lines
from lodegraph.runtime import checkpoint, ensure_importable

WINDOW_BYTES, BLOCK_WINDOW_BYTES, OVERLAP_BYTES = 4000, 48 * 1024, 4 * 1024
UNIT_TARGET, UNIT_MOST = 3500, 6000
#: Bytes of a tile by profile.
PROFILES = {"summary": 8000, "standard": 32000, "deep": 131072}
#: What begins a construct at the top of a file.
CONSTRUCT = re.compile(
    r"(export\s|function\s|async\s|class\s|interface\s|type\s|enum\s|struct\s|extension\s|protocol\s|func\s|fun\s|object\s|def\s|public\s|private\s|internal\s|final\s|abstract\s|import\s|const\s|let\s|var\s|@\w|#\s|##\s|###\s|CREATE\s|ALTER\s|resource\s|module\s|package\s|\w[\w-]*:\s*$)",
    re.ASCII,
)
_HEADING = re.compile(r"#{1,3}\s")


def packed(rows: DataFrame, keys: list[str], order: list[str], size: str, most: int, joint: int = 0) -> DataFrame:
    """`rows` with `window`, from 0 in each group: rows in order share a window while their sizes, and `joint` between any two, come to at most `most`.

    A row above the bound is alone. Groups are dealt over tasks by `keys`; a task holds one running size.
    """
    ensure_importable(rows.sparkSession)
    columns = rows.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, window, held, alone = None, 0, 0, False
        for batch in batches:
            numbers = []
            for key, n in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column(size).to_pylist(), strict=True):
                if key != group:
                    group, window, held, alone = key, 0, n, n > most
                elif alone or n > most or held and held + joint + n > most:
                    window, held, alone = window + 1, n, n > most
                else:
                    held = held + joint + n if held else n
                numbers.append(window)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*columns, "window"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(fold, f"{schema}, window long")


def section_windows(docs: DataFrame, most: int = WINDOW_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, line, line_end, n_sections, path, part, parts, n_bytes): whole sections packed to at most `most` bytes; they partition a document's lines.

    A section runs from its heading to the next one; lines before the first heading are the section "(preamble)". `path` is given where a window is of one section only. A section
    above the bound is cut between lines, numbered part of parts. A document without headings is cut between lines alone, with null path and parts. A line above the bound is alone.
    """
    lines = checkpoint(numbered_lines(docs, key, text).withColumn("n", F.octet_length("content")))
    heads = checkpoint(markdown.headings(lines, key).select(key, "line", "path"))
    ends = lines.groupBy(key).agg(F.max("line").alias("last"))
    following = F.lead("line").over(Window.partitionBy(key).orderBy("line"))
    begun = heads.select(key, "line", "path", following.alias("next"))
    before = heads.groupBy(key).agg(F.min("line").alias("next")).where("next > 1").select(key, F.lit(1).alias("line"), F.lit("(preamble)").alias("path"), "next")
    segments = begun.union(before).join(ends, key).select(key, F.col("line").alias("start"), F.coalesce(F.col("next") - 1, F.col("last")).alias("end"), "path")
    whole = ends.join(heads.select(key).distinct(), key, "left_anti").select(key, F.lit(1).alias("start"), F.col("last").alias("end"), F.lit(None).cast("string").alias("path"))
    upto = F.last("start", ignorenulls=True).over(Window.partitionBy(key).orderBy("line"))
    starts = segments.select(key, F.col("start").alias("line"), "start").union(whole.select(key, "start", "start"))
    owned = lines.join(starts, [key, "line"], "left").select(key, "line", "n", upto.alias("start"))
    sized = checkpoint(owned.groupBy(key, "start").agg((F.sum("n") + F.count(F.lit(1)) - 1).alias("n")).join(segments.union(whole), [key, "start"]))

    fit = sized.where(F.col("path").isNotNull())
    flow = packed(fit.select(key, "start", "end", "path", "n"), [key], ["start"], "n", most, 1)
    grouped = flow.groupBy(key, "window").agg(F.min("start").alias("line"), F.max("end").alias("line_end"), F.count(F.lit(1)).alias("n_sections"), F.min("path").alias("path"), (F.sum("n") + F.count(F.lit(1)) - 1).alias("n_bytes"))
    windows = grouped.where(F.col("n_bytes") <= most).select(key, "line", "line_end", "n_sections", F.when(F.col("n_sections") == 1, F.col("path")).alias("path"), F.lit(None).cast("long").alias("part"), F.lit(None).cast("long").alias("parts"), "n_bytes")
    cut = sized.where(F.col("path").isNull() | (F.col("n") > most)).select(key, "start", "path")
    pieces = packed(owned.join(cut, [key, "start"]).select(key, "start", "path", "line", (F.col("n") + 1).alias("n")), [key, "start"], ["line"], "n", most)
    parts = pieces.groupBy(key, "start", "window").agg(F.min("line").alias("line"), F.max("line").alias("line_end"), F.min("path").alias("path"), (F.sum("n") - 1).alias("n_bytes"))
    among = Window.partitionBy(key, "start")
    sectioned = F.col("path").isNotNull()
    numbered = parts.withColumn("parts", F.when(sectioned, F.count(F.lit(1)).over(among))).select(key, "line", "line_end", F.when(sectioned, 1).cast("long").alias("n_sections"), "path", F.when(sectioned, F.col("window") + 1).alias("part"), "parts", "n_bytes")
    return windows.unionByName(numbered)


def block_windows(docs: DataFrame, most: int = BLOCK_WINDOW_BYTES, overlap: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, window, kind, start, n_bytes, n_blocks, context_start, context_bytes): Markdown blocks packed to at most `most` bytes, with the blocks before them as context.

    A block is primary in one window only. The context is the run of last blocks of the window before that first reaches `overlap` bytes (by default a quarter of the window, 4 KiB at most);
    a block above the bound is a window without context. A document that fits is one window, `whole_document`.
    """
    overlap = min(OVERLAP_BYTES, most // 4) if overlap is None else overlap
    if not 0 <= overlap < most:
        raise ValueError("the overlap must be less than the window")
    blocks = checkpoint(markdown.blocks(numbered_lines(docs, key, text), key).select(key, "block", "start", "n_bytes"))
    total = blocks.groupBy(key).agg(F.sum("n_bytes").alias("_total"))
    fits = total.where(F.col("_total") <= most).select(key)
    flow = checkpoint(packed(blocks.join(fits, key, "left_anti"), [key], ["block"], "n_bytes", most))
    behind = F.coalesce(F.sum("n_bytes").over(Window.partitionBy(key, "window").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    context = flow.withColumn("_behind", behind).where(F.col("_behind") < overlap).groupBy(key, (F.col("window") + 1).alias("window")).agg(F.min("start").alias("context_start"), F.sum("n_bytes").alias("context_bytes"))
    made = flow.groupBy(key, "window").agg(F.min("start").alias("start"), F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_blocks")).join(context, [key, "window"], "left")
    single = F.col("n_bytes") > most
    cut = made.select(key, "window", F.lit("overlapping_window").alias("kind"), "start", "n_bytes", "n_blocks", F.when(~single, F.col("context_start")).alias("context_start"), F.when(single, 0).otherwise(F.coalesce("context_bytes", F.lit(0))).alias("context_bytes"))
    kept = blocks.join(fits, key, "left_semi").groupBy(key).agg(F.min("start").alias("start"), F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_blocks"))
    return kept.select(key, F.lit(0).cast("long").alias("window"), F.lit("whole_document").alias("kind"), "start", "n_bytes", "n_blocks", F.lit(None).cast("long").alias("context_start"), F.lit(0).cast("long").alias("context_bytes")).unionByName(cut)


def cut_units(lines: list[str], target: int = UNIT_TARGET, most: int = UNIT_MOST) -> list[tuple[int, int, int]]:
    """Units (first line, last line, bytes) of a text's lines: cut before a heading or construct, else after a blank line, else where the bound is reached.

    A cut is sought from half the target on and taken once the target is reached; the best kind wins, and the last of a kind. Where none was found, the unit ends at `most` bytes.
    """
    def rank(i: int) -> int:
        blank = i > 0 and not lines[i - 1].strip()
        if CONSTRUCT.match(lines[i]) and (blank or _HEADING.match(lines[i])):
            return 3
        return (2 if lines[i] and not lines[i][0].isspace() else 1) if blank else 0

    ranks = [rank(i) for i in range(len(lines))]
    upto = [0, *accumulate(len(line.encode("utf-8", "surrogatepass")) + 1 for line in lines)]
    units, start, read = [], 0, 0
    while start < len(lines):
        best, end = None, len(lines)
        for i in range(read, len(lines)):
            if ranks[i] and 2 * (upto[i] - upto[start]) >= target and (best is None or ranks[i] >= ranks[best]):
                best = i
            read, size = i + 1, upto[i + 1] - upto[start]
            if size >= target and best is not None or size >= most:
                end = best if size >= target and best is not None else i + 1
                break
        units.append((start + 1, end, upto[end] - upto[start] - 1))
        start = end
    return units


def text_units(docs: DataFrame, target: int = UNIT_TARGET, most: int = UNIT_MOST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, unit, n_units, line, line_end, n_bytes, sha256): `cut_units` of every whole text; units partition its lines. A null or empty text has none, and a last empty line is no line."""
    ensure_importable(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in (whole.slice(at, step) for whole in batches for step in [max(1, int(whole.num_rows * BATCH_BYTES / max(whole.nbytes, 1)))] for at in range(0, whole.num_rows, step)):
            rows = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = (value or "").split("\n")
                if not lines[-1]:
                    lines.pop()
                units = cut_units(lines, target, most)
                rows += [(doc, k, len(units), a, b, n, sha256("\n".join(lines[a - 1 : b]).encode("utf-8", "surrogatepass")).hexdigest()) for k, (a, b, n) in enumerate(units)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[key, "unit", "n_units", "line", "line_end", "n_bytes", "sha256"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(cut, f"`{key}` {kind}, unit long, n_units long, line long, line_end long, n_bytes long, sha256 string")


def tile_text(scope_json: Column, address: Column, rows: Column, included: Column, total: Column) -> Column:
    """A tile as JSON: what its scope says, the rows that fit, and exactly how many there are and are left out."""
    head = F.concat(F.substring(scope_json, F.lit(1), F.length(scope_json) - 1), F.lit(',"node_rows":['), rows, F.lit('],"node_rows_included":'), included.cast("string"), F.lit(',"node_rows_total":'), total.cast("string"))
    rest = total - included
    address = F.when(rest > 0, F.concat(F.lit('"'), address, F.lit("/nodes?after="), included.cast("string"), F.lit('"'))).otherwise("null")
    return F.concat(head, F.lit(',"node_rows_omitted":'), rest.cast("string"), F.lit(',"continuation_address":'), address, F.lit("}"))


def tiles(scopes: DataFrame, members: DataFrame, profiles: Mapping[str, int] | None = None) -> DataFrame:
    """Rows (scope, profile, included, total, n_bytes, tile) of scopes (scope, address, json): for each profile the first members (scope, member) by id that fit its bytes.

    At least one member is given if there is any. A budget can't hold more rows than a third of its bytes, so no more of a scope are ranked together; the total counts all.
    """
    profiles = PROFILES if profiles is None else profiles
    rank = Window.partitionBy("scope").orderBy("member")
    first = members.withColumn("nth", F.row_number().over(rank)).where(F.col("nth") <= max(profiles.values()) // 3)
    row = F.to_json(F.struct(F.col("member").alias("m")))
    row = F.substring(row, F.lit(6), F.length(row) - 6)  # the string of {"m":...}
    total = members.groupBy("scope").agg(F.count(F.lit(1)).alias("total"))
    listed = first.select("scope", "nth", row.alias("row")).join(total, "scope").join(scopes, "scope")
    so_far = F.sum(F.octet_length("row") + 1).over(Window.partitionBy("scope").orderBy("nth")) - 1
    # The address stands also where nothing is left out, so that a prefix that fits never depends on what follows it.
    frame = F.octet_length(F.concat(F.substring("json", F.lit(1), F.length("json") - 1), F.lit(',"node_rows":[],"node_rows_included":,"node_rows_total":,"node_rows_omitted":,"continuation_address":"'), "address", F.lit('/nodes?after="}')))
    digits = 2 * F.length(F.col("nth").cast("string")) + F.length(F.col("total").cast("string")) + F.length((F.col("total") - F.col("nth")).cast("string"))
    weighed = checkpoint(listed.select("scope", "nth", "row", (frame + digits + so_far).alias("_bytes")))
    budgets = F.explode(F.array(*[F.struct(F.lit(name).alias("profile"), F.lit(most).alias("most")) for name, most in profiles.items()])).alias("p")
    kept = weighed.select("scope", "nth", "row", "_bytes", budgets).where((F.col("_bytes") <= F.col("p.most")) | (F.col("nth") == 1))
    held = kept.groupBy("scope", "p.profile").agg(F.count(F.lit(1)).alias("included"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "row"))), lambda r: r["row"]), ",").alias("rows"))  # bounded by the budget
    asked = scopes.select("scope", "address", "json", budgets).select("scope", "address", "json", "p.profile").join(total, "scope", "left").join(held, ["scope", "profile"], "left")
    counted = asked.withColumn("included", F.coalesce("included", F.lit(0))).withColumn("total", F.coalesce("total", F.lit(0)))
    tile = tile_text(F.col("json"), F.col("address"), F.coalesce("rows", F.lit("")), F.col("included"), F.col("total"))
    return counted.withColumn("tile", tile).select("scope", "profile", "included", "total", F.octet_length("tile").alias("n_bytes"), "tile")
