"""Packing by non-negative least squares: windows are filled exactly by shallow combinations of lengths.

Documents are cut into whole windows and one remainder. Which remainders share a window is decided
on the histogram of their lengths, at most `window` - 1 rows whatever the corpus holds:

1. all combinations of two or three lengths that fill a window exactly are enumerated;
2. non-negative least squares finds how often each is repeated so that together they use up the histogram;
3. the repeat counts are rounded within what the histogram has;
4. what is left is packed greedily: first into further exact combinations, longest lengths first, and
   then end to end, where a piece is cut at the end of each window. The last window that this leaves
   incomplete is cut at powers of two, which aren't padded. So no sequence is padded at all.

Spark tokenises once, ranks the remainders of each length (salted, so that a length which a third
of them share is ranked by many tasks) and joins ranks with the plan. Ids are read again only
for remainders that are cut; whole windows are never shuffled.

Defined cases: a null or empty text has only the end id; very long texts are tokenised whole; equal remainders take places in
any order; rows that repeat a doc_id are separate documents; a null doc_id is carried; an empty table gives an
empty result; other columns of the input are dropped.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.llm.common import map_batches
from lodegraph.runtime import BROADCAST_ROWS, written

WINDOW = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k"
#: Remainders of one length that a task ranks at once; a length is dealt over as many parts as that takes.
RANKED = 250_000
#: The solver ends when repeats and histogram differ by this share of all remainders, or after so many rounds; the greedy steps have the rest.
TOLERANCE, ROUNDS = 0.01, 100

_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
_NUMBERS = (("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()))


class ByteTokenizer:
    """Ids of texts as little-endian bytes.

    The rank file holds the vocabulary of the tokenizer file and is encoded faster; texts that hold a special
    token go to the tokenizer itself.
    """

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if self.special.search(text) else self.ranks.encode_ordinary(text)
        return np.asarray(ids, dtype="<u4").tobytes()


_TOKENIZERS: dict[str, ByteTokenizer] = {}


def byte_tokenizer(name: str = VOCABULARY) -> ByteTokenizer:
    """One per worker process."""
    if name not in _TOKENIZERS:
        _TOKENIZERS[name] = ByteTokenizer(name)
    return _TOKENIZERS[name]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)


def token_pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Whole windows and the remainder of each document; `ids` (bytes) only of remainders."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, rows = byte_tokenizer(vocabulary).encode, []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = encode(text or "") + end
            for at in range(0, len(ids), 4 * window):
                part = ids[at : at + 4 * window]
                rows.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part if len(part) < 4 * window else None))
        return _batch(rows, [*_COLUMNS, "ids"], [batch.schema.field("doc_id").type, *(k for _, k in _NUMBERS), pa.binary()])

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", "text"), cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All rows (a, b, c) with a >= b >= c >= 0, a + b + c = window and every length above 0 among `lengths`."""
    known = np.zeros(window + 1, dtype=bool)
    known[lengths] = True
    known[0] = True  # no third part
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = window - a - b
    fits = (a >= b) & (c >= 0) & (b >= c)
    a, b, c = a[fits], b[fits], c[fits]
    return np.stack([a, b, c], axis=1)[known[c]]


def repeat_counts(parts: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Non-negative least squares: repeats of each combination that use up the histogram best.

    An active-set method. Each round lets in the combinations that lower the error most and share no length, solves
    the least squares over those that are in, and moves towards that solution until a repeat count would
    turn negative; such a combination leaves.
    """
    repeats = np.zeros(len(parts))
    scale = float(histogram.max(initial=0))
    if not len(parts) or not scale:
        return repeats
    size, goal = len(histogram), histogram / scale
    entries, columns, gram = np.zeros(0, dtype=np.int64), np.zeros((size, 0)), np.zeros((0, 0))
    for _ in range(rounds):
        used = np.bincount(parts.ravel(), weights=np.repeat(repeats, 3), minlength=size)
        missing = goal - used
        missing[0] = 0
        if np.abs(missing).sum() <= tolerance * goal.sum():
            break
        gain = missing[parts].sum(axis=1)
        gain[entries] = -1
        taken, new = np.zeros(size, dtype=bool), []
        for k in np.argsort(-gain, kind="stable")[:2000]:
            if gain[k] <= 1e-7:
                break
            own = parts[k][parts[k] > 0]
            if not taken[own].any():
                taken[own] = True
                new.append(int(k))
        if not new:
            break
        fresh = np.zeros((size, len(new)))
        for part in parts[new].T:
            np.add.at(fresh, (part, np.arange(len(new))), 1.0)
        fresh[0] = 0
        cross = columns.T @ fresh
        gram = np.block([[gram, cross], [cross.T, fresh.T @ fresh]])
        columns, entries = np.hstack([columns, fresh]), np.concatenate([entries, new])
        while len(entries):
            best = np.linalg.solve(gram + 1e-9 * np.eye(len(entries)), columns.T @ goal)
            if (best > 0).all():
                repeats[entries] = best
                break
            now, negative = repeats[entries], best <= 0
            step = (now[negative] / (now[negative] - best[negative] + 1e-300)).min()
            moved = np.maximum(now + step * (best - now), 0)
            stays = ~negative | (moved > 1e-12)
            if stays.all():
                stays[np.flatnonzero(negative)[np.argmin(moved[negative])]] = False
            repeats[entries] = np.where(stays, moved, 0)
            entries, columns, gram = entries[stays], columns[:, stays], gram[np.ix_(stays, stays)]
        if not np.isin(new, entries).any():
            break
    return repeats * scale


Run = tuple[int, int, int, int, int, int]


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[Run], dict[int, int], int]:
    """Runs (length, first_rank, n, first_sequence, per_sequence, base), first rank of each length that is left over, sequences used.

    The remainders of `length` with ranks from first_rank on fill consecutive sequences from
    first_sequence, per_sequence in each, the first of them at offset base.
    """
    left = np.zeros(window + 1, dtype=np.int64)
    for length, n in histogram.items():
        if not 0 < length < window:
            raise ValueError(f"a remainder of {length} in windows of {window}")
        left[length] = n
    ranks, runs, sequences = np.zeros(window + 1, dtype=np.int64), [], 0

    def most(part: np.ndarray) -> int:
        lengths, times = np.unique(part[part > 0], return_counts=True)
        return int((left[lengths] // times).min())

    def fill(part: np.ndarray, times: int) -> None:
        nonlocal sequences
        base = 0
        for length, each in zip(*np.unique(part[part > 0], return_counts=True), strict=True):
            runs.append((int(length), int(ranks[length]), int(each) * times, sequences, int(each), base))
            ranks[length] += each * times
            left[length] -= each * times
            base += int(length * each)
        sequences += times

    parts = combinations(np.flatnonzero(left), window)
    repeats = repeat_counts(parts, left.astype(float))
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] < 0.5:
            break
        if times := min(int(np.rint(repeats[k])), most(parts[k])):
            fill(parts[k], times)
    for length in range(window - 1, (window - 1) // 3, -1):
        while left[length]:
            rest = window - length
            second = np.arange(-(-rest // 2), min(rest, length) + 1)
            third = rest - second
            need = np.where(second == length, 2, 1) + 0 * second
            room = np.minimum(left[second] - (need - 1), np.where(third > 0, left[third], np.iinfo(np.int64).max))
            room = np.where(second == third, np.minimum(room, left[second] // 2), room)
            if not len(room) or room.max() <= 0:
                break
            at = int(np.argmax(room))
            part = np.asarray([length, second[at], third[at]])
            if not (times := most(part)):
                break
            fill(part, times)
    return runs, {int(length): int(ranks[length]) for length in np.flatnonzero(left)}, sequences


def tail_bounds(tokens: int, window: int = WINDOW) -> list[int]:
    """Ends of the sequences after the whole windows of a tail: the rest in descending powers of two."""
    at, rest = tokens - tokens % window, tokens % window
    ends = []
    while rest:
        power = 1 << (rest.bit_length() - 1)
        at, rest = at + power, rest - power
        ends.append(at)
    return ends


def _cut_tail(tail: DataFrame, first_sequence: int, tokens: int, window: int) -> DataFrame:
    """Pieces of remainders that lie end to end from token `_at` on, cut where sequences end."""
    whole, ends = tokens - tokens % window, tail_bounds(tokens, window)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, start, total, at, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "_at", "ids")), strict=True):
            done, n = 0, len(ids) // 4
            while done < n:
                place = at + done
                if place < whole:
                    sequence, begin, end = place // window, place - place % window, place - place % window + window
                else:
                    k = next(i for i, e in enumerate(ends) if e > place)
                    sequence, begin, end = whole // window + k, ends[k - 1] if k else whole, ends[k]
                size = min(n - done, end - place)
                rows.append((doc_id, start + done, size, zlib.crc32(ids[4 * done : 4 * (done + size)]), total, 2 * (first_sequence + sequence), place - begin))
                done += size
        return _batch(rows, [*_COLUMNS, "sequence_id", "offset"], [batch.schema.field("doc_id").type, *(k for _, k in _NUMBERS), pa.int64(), pa.int64()])

    kind = dict(tail.dtypes)["doc_id"]
    return map_batches(tail, cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_pieces(pieces: DataFrame, window: int = WINDOW, ranked: int = RANKED, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`pieces` (materialised; as `token_pieces`, with `_uid` naming each row) with sequence_id and offset."""
    spark = pieces.sparkSession
    whole = pieces.where(F.col("length") == window).select(*_COLUMNS, (2 * F.col("_uid") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < window).select("_uid", *_COLUMNS)
    salts = max(8, -(-rest.count() // ranked))
    salted = rest.withColumn("_salt", F.pmod(F.xxhash64("_uid"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("length").alias("_length"), F.col("_salt").alias("_s"), before.alias("_before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # fewer than `window` rows
    runs, left, sequences = plan(histogram, window)

    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_uid")) - 1
    placed = salted.withColumn("_own", own).join(starts, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_s")))
    placed = placed.withColumn("_rank", F.col("_own") + F.col("_before"))
    table = spark.createDataFrame(runs, "_of long, _first long, _n long, _sequence long, _each long, _base long")
    nth = F.col("_rank") - F.col("_first")
    fitted = placed.join(F.broadcast(table), (F.col("length") == F.col("_of")) & (nth >= 0) & (nth < F.col("_n"))).select(  # a bounded number of runs, whatever the input
        *_COLUMNS,
        (2 * (F.col("_sequence") + F.floor(nth / F.col("_each")))).cast("long").alias("sequence_id"),
        (F.col("_base") + F.pmod(nth, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )

    offsets, tokens = [], 0
    for length, first in sorted(left.items(), reverse=True):
        offsets.append((length, first, tokens))
        tokens += length * (histogram[length] - first)
    if not tokens:
        return whole.unionByName(fitted)
    cuts = placed.join(F.broadcast(spark.createDataFrame(offsets, "_of long, _first long, _from long")), (F.col("length") == F.col("_of")) & (nth >= 0))  # fewer than `window` rows
    cuts = cuts.select("_uid", (F.col("_from") + nth * F.col("length")).alias("_at"))
    n_cut = sum(histogram[length] - first for length, first in left.items())
    ids = pieces.where(F.col("length") < window).select("_uid", "doc_id", "start", "doc_tokens", "ids")
    tail = ids.join(F.broadcast(cuts) if n_cut <= broadcast_rows else cuts, "_uid")
    return whole.unionByName(fitted).unionByName(_cut_tail(tail, sequences, tokens, window))


def pack_windows(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack `docs`; one row per piece."""
    return pack_pieces(written(token_pieces(docs, window, vocabulary, end_id).withColumn("_uid", F.monotonically_increasing_id())), window)
