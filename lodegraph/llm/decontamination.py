"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

An item of m characters is found in a text when some substring is within k = floor(rate * m)
edits of it. Cut the item into k + 1 pieces: k edits leave at least one piece intact, so every
such substring holds a piece exactly. One Aho-Corasick pass finds all pieces of all items; the
places where an item may stand are merged into windows, and Myers' bit-parallel algorithm computes
the least distance of the item to any substring of a window. Nothing within the budget is missed,
and nothing beyond it is reported.

Texts and items are compared in lower case with white space runs as one blank. The benchmark is
the query set, dealt into blocks of about `BLOCK_CHARS` characters by the executors, which write them to the shared folder as files
that Spark hands to every worker; the driver sees their names only. The corpus is passed over once: a worker holds one
block's automaton at a time, and if there are several blocks, it gathers `HELD_BYTES` of text before it goes through them. So neither memory nor the plan grows with the benchmark.

The budget is floor(rate * m) edits for an item of any length. Where that is none, the item must
stand whole, between characters that are no letters or digits (or at the text's ends).

Defined cases: null or empty texts and items match nothing; texts of any length are searched whole; of places
at equal distance the first is reported;
rows that repeat a doc_id are searched apart; items that repeat are each reported; empty tables
give empty results; other columns of the documents are carried, and one named `hits` is replaced.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import BATCH_BYTES, bound_batches
from lodegraph.runtime import ensure_importable, shared_dir

RATE = 0.06
BLOCK_CHARS = 2_000_000
#: Bytes of text that a worker gathers before it goes through more than one block.
HELD_BYTES = 32_000_000

_WORD = re.compile(r"\S+")


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item cut into budget + 1 parts of near equal length, with their offsets."""
    cuts = [i * len(item) // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of `pattern` to a substring of `text`, and where the first such substring ends."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    mask: dict[str, int] = {}
    for i, c in enumerate(pattern):
        mask[c] = mask.get(c, 0) | 1 << i
    plus, minus, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text, 1):
        eq = mask.get(c, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        up, down = minus | (full & ~(d0 | plus)), plus & d0
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score < best:
            best, end = score, at
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(d0 | up)), up & d0
    return best, end


class Matcher:
    """The pieces of a block of items, and the search for items in a text."""

    def __init__(self, items: list[tuple], rate: float = RATE):
        import ahocorasick

        self.items = [(i, n, int(rate * len(n))) for i, text in items if text and (n := normal(text))]
        places: dict[str, list[tuple[int, int]]] = {}
        for at, (_, item, budget) in enumerate(self.items):
            for offset, piece in pieces(item, budget):
                places.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, held in places.items():
            self.automaton.add_word(piece, (len(piece), held))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """By item, the merged stretches of a text where it may stand."""
        found: dict[int, list[tuple[int, int]]] = {}
        for last, (length, held) in self.automaton.iter(text):
            for at, offset in held:
                _, item, budget = self.items[at]
                start = last + 1 - length - offset
                if not budget and not self._stands_alone(text, start, last + 1):
                    continue
                found.setdefault(at, []).append((max(0, start - budget), min(len(text), start + len(item) + budget)))
        merged: dict[int, list[list[int]]] = {}
        for at, spans in found.items():
            out: list[list[int]] = []
            for low, high in sorted(spans):
                if out and low <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], high)
                else:
                    out.append([low, high])
            merged[at] = out
        return merged

    @staticmethod
    def _stands_alone(text: str, low: int, high: int) -> bool:
        return not (low and text[low - 1].isalnum() and text[low].isalnum()) and not (high < len(text) and text[high].isalnum() and text[high - 1].isalnum())

    def find(self, raw: str | None) -> list[dict]:
        """The best place of every item found: item_id, distance, start, end (code points of the raw text)."""
        if not raw or self.empty:
            return []
        text, hits = normal(raw), []
        for at, spans in self.windows(text).items():
            item_id, item, budget = self.items[at]
            best = None
            for low, high in spans:
                distance, end = myers(item, text[low:high])
                if distance <= budget and (best is None or distance < best[0]):
                    start = low + end - myers(item[::-1], text[low : low + end][::-1])[1]
                    best = (distance, start, low + end)
            if best:
                hits.append((item_id, *best))
        if not hits:
            return []
        place = list(self._raw_places(raw, text))
        return [{"item_id": i, "distance": d, "start": place[a], "end": place[b - 1] + 1} for i, d, a, b in sorted(hits, key=lambda h: h[2:])]

    @staticmethod
    def _raw_places(raw: str, text: str) -> Iterator[int]:
        """For each character of the normal text, its place in the raw text."""
        for n, m in enumerate(_WORD.finditer(raw)):
            if n:
                yield m.start() - 1
            for i, c in enumerate(m[0], m.start()):
                for _ in c.lower():
                    yield i


def written_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[str]:
    """Names of the files, known to every worker, that hold the benchmark's items in blocks of about `block_chars` characters."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    if not total:
        return []
    folder = f"{shared_dir(spark).rstrip('/')}/blocks/{uuid.uuid4().hex}"
    dealt = items.repartition(max(1, -(-total // block_chars)), F.xxhash64("item_id", "text"))
    dealt.select(F.to_json(F.struct("item_id", "text"), {"ignoreNullFields": "false"}).alias("value")).write.text(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    parts = sorted(f.getPath().toString() for f in files if f.getPath().getName().startswith("part-"))
    for part in parts:
        spark.sparkContext.addFile(part)
    return [part.rsplit("/", 1)[1] for part in parts]


@lru_cache(maxsize=1)
def block_matcher(name: str, rate: float) -> Matcher:
    """The matcher of a block; a worker keeps the last one."""
    from pyspark import SparkFiles

    with open(SparkFiles.get(name), encoding="utf-8") as lines:
        items = [(row["item_id"], row["text"]) for row in map(json.loads, lines)]
    return Matcher(sorted(items, key=repr), rate)


def search(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS, held_bytes: int = HELD_BYTES) -> DataFrame:
    """`docs` with hits: array of (item_id, distance, start, end), empty where nothing is found."""
    spark = docs.sparkSession
    ensure_importable(spark)
    bound_batches(spark)
    item_kind = dict(benchmark.dtypes)["item_id"]
    columns = [c for c in docs.columns if c.lower() != "hits"]
    hit_type = pa.list_(pa.struct([("item_id", _arrow(benchmark, "item_id")), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"hits array<struct<item_id: {item_kind}, distance: int, start: bigint, end: bigint>>"])
    blocks = written_blocks(benchmark, block_chars)

    def searched(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [batch.column("text").to_pylist() for batch in held]
        found: list[list[list[dict]]] = [[[] for _ in part] for part in texts]
        for name in blocks:
            matcher = block_matcher(name, rate)
            for part, out in zip(texts, found, strict=True):
                for text, hits in zip(part, out, strict=True):
                    hits += matcher.find(text)
        for batch, out in zip(held, found, strict=True):
            out = [sorted(hits, key=lambda h: (h["start"], h["end"])) for hits in out]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, hit_type)], names=[*columns, "hits"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            step = max(1, int(whole.num_rows * BATCH_BYTES / max(whole.nbytes, 1)))
            for at in range(0, whole.num_rows, step):
                held.append(whole.slice(at, step))
                size += held[-1].nbytes
                if len(blocks) < 2 or size >= held_bytes:
                    yield from searched(held)
                    held, size = [], 0
        if held:
            yield from searched(held)

    return docs.select(*columns).mapInArrow(look, schema)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, distance, start, end."""
    return search(docs.select("doc_id", "text"), benchmark, rate).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents in which no item is found, with their columns."""
    return search(docs, benchmark, rate).where(F.size("hits") == 0).select(*[c for c in docs.columns if c.lower() != "hits"])
