"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Lengths are integers from 1 to the capacity, so pieces of equal length are interchangeable and
the whole corpus is described by a histogram of at most `capacity` rows. Best-fit decreasing is
run on that histogram: lengths descend, and each takes the open bins whose remaining capacity is
tightest, found by a segment tree over remaining capacities in logarithmic time. Equal bins are
handled as one range of sequence numbers, so the plan has a bounded number of runs whatever the
corpus holds, and it equals the document-by-document algorithm. Spark ranks the pieces of each
length (salted, so a length that a third of the pieces share is ranked by many tasks) and joins
ranks with runs; no document passes through the driver.

Defined cases: a null or empty text has only the end id; very long texts are tokenised whole and cut into pieces; equal pieces
take places in any order; rows that repeat a doc_id are separate
documents; a null doc_id is carried; an empty table gives an empty result; other columns of the
input are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.llm.common import map_batches
from lodegraph.runtime import broadcast_if_small, written

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that a task ranks at once; a length is dealt over as many parts as that takes.
RANKED = 250_000
VOCABULARY = "word_bpe_49k.json"
#: Words and white-space runs a worker remembers; beyond this it forgets all and starts anew.
REMEMBERED = 900_000

#: In texts of these characters alone, normalisation is lower-casing and words are split by _WORD.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|(?:[^\s\w]|_)+")


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of texts as little-endian bytes; each word is encoded once by the tokenizer.

    The tokenizer splits text at white space and then into words, so the ids of a text are those
    of its words in order. Texts with special tokens or with characters outside Latin ranges are
    given to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, chunks: set[str]) -> None:
        parts = {c: _WORD.findall(c) for c in chunks}
        new = iter({w for words in parts.values() for w in words} - self.words.keys())
        while some := list(islice(new, 2000)):
            ids = np.asarray(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
            if len(ends) != len(some):
                self.words.update((w, self._whole(w)) for w in some)
                continue
            raw, low = ids.tobytes(), 0
            for word, high in zip(some, ends.tolist(), strict=True):
                self.words[word] = raw[low:high]
                low = high
        self.chunks.update((c, b"".join(map(self.words.__getitem__, words))) for c, words in parts.items())

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.chunks) + len(self.words) > REMEMBERED:
            self.words.clear()
            self.chunks.clear()
        plain = [t.lower().split() if _PLAIN.fullmatch(t) and not self.special.search(t) else None for t in texts]
        seen: set[str] = set()
        for chunks in plain:
            if chunks:
                seen.update(chunks)
        self._learn(seen - self.chunks.keys())
        for text, chunks in zip(texts, plain, strict=True):
            yield self._whole(text) if chunks is None else b"".join(map(self.chunks.__getitem__, chunks))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process, so that tasks share what it has learnt."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    path, end = path or tokenizer_path(), np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), word_tokenizer(path).encode(texts), strict=True):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        names, kinds = ("doc_id", "piece", "start", "length", "ids_crc32"), (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", "text"), cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class CapacityTree:
    """Segment tree over remaining capacities: which have open bins, and the least at or above a length."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, remaining: int, n: int) -> None:
        at = remaining + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, length: int) -> int:
        """The least remaining capacity of at least `length` with an open range of bins, or -1."""
        at = length + self.leaves
        if self.count[at]:
            return length
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Runs (length, first_rank, n, first_sequence, per_sequence, base): the pieces of `length` with
    ranks from first_rank on fill consecutive sequences from first_sequence, per_sequence in each,
    the first of them at offset base.
    """
    tree, open_bins, runs, opened = CapacityTree(capacity), {}, [], 0

    def put(remaining: int, first: int, n: int) -> None:
        if remaining and n:
            open_bins.setdefault(remaining, []).append((first, n))
            tree.add(remaining, 1)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit {capacity}")
        while left:
            remaining = tree.tightest(length)
            if remaining < 0:
                remaining, each = capacity, capacity // length
                first, bins = opened, -(-left // each)
                opened += bins
            else:
                first, bins = open_bins[remaining].pop()
                tree.add(remaining, -1)
                each = remaining // length
            used = min(left, each * bins)
            runs.append((length, rank, used, first, each, capacity - remaining))
            full, rest = divmod(used, each)
            put(remaining - each * length, first, full)
            if rest:
                put(remaining - rest * length, first + full, 1)
            put(remaining, first + full + bool(rest), bins - full - bool(rest))
            left, rank = left - used, rank + used
    return runs


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """`pieces` (materialised; doc_id, piece, length, ...) with sequence_id and offset."""
    spark = pieces.sparkSession
    salts = max(8, -(-pieces.count() // ranked))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("length").alias("_length"), F.col("_salt").alias("_s"), before.alias("_before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.createDataFrame(plan_runs(histogram, capacity), "_of long, _first long, _n long, _sequence long, _each long, _base long")
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_own", own).join(starts, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_s")))
    ranked = ranked.withColumn("_rank", F.col("_own") + F.col("_before"))
    placed = ranked.join(broadcast_if_small(runs), (F.col("length") == F.col("_of")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_n")))
    nth = F.col("_rank") - F.col("_first")
    return placed.select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_base") + F.pmod(nth, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Tokenise, cut and pack `docs`; one row per piece."""
    return pack_pieces(written(token_pieces(docs, capacity, path)), capacity)
