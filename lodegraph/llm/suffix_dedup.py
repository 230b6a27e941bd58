"""Removal of byte strings that occur more than once, by suffix arrays built with linear grouping.

A window is a string of `length` bytes inside one document; a window is repeated if it also
starts anywhere else in the corpus. All bytes that repeated windows cover are removed.

Spark first brings together the windows that can be equal. In every window the k-gram of least
hash (the leftmost, on ties) is its anchor, so equal windows have equal anchors at equal places.
Successive windows with the same anchor are one context, of some 1.3 times `length` bytes.
Contexts whose anchor k-gram occurs only once are dropped, equal contexts are collapsed to one
with a weight, and the bytes of the rest are sent to the task that holds their anchor's hash.

A task cuts its contexts into blocks aligned to their anchors, ranks the blocks, and sorts all
suffixes of the block text with the linear grouping construction: suffixes are grouped by first
symbol; groups are taken in descending order, every suffix gets a pointer to the previous suffix
of a lower group, and those are moved up behind their group by how many point to them, so that
groups end as equal Lyndon prefixes; a second pass follows the pointers from each placed suffix
and emits the order inside the groups, without renaming or recursion. Neighbours in suffix order
that share their blocks form intervals; inside an interval, windows are equal exactly when the
bytes before and after their whole blocks are. Windows of total weight two or more are repeated.

An anchor that has more than `HOT` distinct contexts isn't gathered into one task: its contexts are
cut again by a second anchor, chosen by another hash, then by a third and so on, and the parts go
through the same sort. Only windows that still crowd after `SPLITS` anchors (thousands of
variants that differ in none of the chosen places) are counted by 128-bit digest with map-side combining.

Equal contexts at even distances, as in periodic text, are kept as runs (first, step, number). Inside a
group the sort restores text order by comparison, so it is linear but for a logarithm.

Defined cases: texts of any length are whole (cut into overlapping pieces of 8 MB for their anchors); a null or empty text has no bytes; rows that repeat a doc_id are separate
documents (equal rows repeat each other); a null doc_id is carried; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import BATCH_BYTES, map_batches, text_key
from lodegraph.runtime import broadcast_if_small, checkpoint, discard, ensure_importable, written

LENGTH = 400
#: Bytes of an anchor k-gram (a power of two), and of a block of the suffix text.
GRAM, BLOCK = 128, 40
#: Distinct contexts of an anchor beyond which they are split by further anchors, and how many of these there are.
HOT, SPLITS = 8192, 6
#: Bytes of contexts whose suffixes a task sorts at once (whole anchors, so possibly more).
SORT_BYTES = 2_000_000
#: Windows whose edges are compared at once.
EDGE_ROWS = 200_000

_U64 = np.uint64
_PIECE = 1 << 23


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(31))) * _U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U64(29))


_BYTES = _mixed(_mixed(np.arange(1, 257, dtype=_U64) * _U64(0x9E3779B97F4A7C15)))


# --- anchors and contexts -------------------------------------------------------------------


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the `gram` bytes from each position, by doubling."""
    out, span = _BYTES[data], 1
    while span < gram:
        out = _mixed(out[:-span] * _U64(0xC2B2AE3D27D4EB4F) + out[span:])
        span *= 2
    return out


def anchor_runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of successive windows with one anchor: hash, anchor position, first and last window start."""
    hashes = gram_hashes(data, gram)
    if seed:
        hashes = _mixed((hashes + _U64(seed)) * _U64(0x9E3779B97F4A7C15))
    wide, n = length - gram + 1, len(data) - length + 1
    packed = (hashes & _U64(~0xFFFFFF & (1 << 64) - 1)) | np.arange(len(hashes), dtype=_U64)
    padded = np.full(-(-len(packed) // wide) * wide, ~_U64(0), dtype=_U64)
    padded[: len(packed)] = packed
    table = padded.reshape(-1, wide)
    before = np.minimum.accumulate(table, 1).reshape(-1)
    after = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].reshape(-1)
    anchor = (np.minimum(after[:n], before[wide - 1 : wide - 1 + n]) & _U64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    return hashes[anchor[first]], anchor[first], first, last


def contexts_of(data: bytes, length: int = LENGTH, gram: int = GRAM) -> dict[bytes, tuple[int, int, int, list[list[int]]]]:
    """By digest of its bytes, each context of a text: anchor hash, windows, anchor offset, runs of starts.

    A run (first, step, number) has a step of at most `length`, so the windows of a run overlap or touch.
    """
    import xxhash

    found: dict[bytes, tuple[int, int, int, list[list[int]]]] = {}
    for at in range(0, max(0, len(data) - length + 1), _PIECE):
        part = np.frombuffer(data[at : at + _PIECE + length - 1], dtype=np.uint8)
        hashes, anchors, lows, highs = anchor_runs(part, length, gram)
        for h, a, low, high in zip(hashes.view(np.int64).tolist(), anchors.tolist(), lows.tolist(), highs.tolist(), strict=True):
            key = xxhash.xxh3_128_digest(data[at + low : at + high + length])
            if key not in found:
                found[key] = (h, high - low + 1, a - low, [[at + low, 0, 1]])
                continue
            run = found[key][3][-1]
            step = at + low - run[0] - (run[2] - 1) * run[1]
            if step <= length and run[2] == 1:
                run[1:] = step, 2
            elif step == run[1]:
                run[2] += 1
            else:
                found[key][3].append([at + low, 0, 1])
    return found


_STARTS = "array<struct<at: bigint, step: bigint, n: bigint>>"


def anchored(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document and distinct context: h, digest, doc_id, row_key, n, rel, starts (runs), times."""
    run_type = pa.list_(pa.struct([("at", pa.int64()), ("step", pa.int64()), ("n", pa.int64())]))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for doc_id, row_key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_key", "text")), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            for digest, (h, n, rel, starts) in contexts_of(data, length, gram).items():
                rows.append((h, digest, doc_id, row_key, n, rel, [{"at": a, "step": d, "n": k} for a, d, k in starts], sum(r[2] for r in starts)))
        kinds = (pa.int64(), pa.binary(), batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32(), run_type, pa.int64())
        columns = zip(*rows, strict=True) if rows else [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "digest", "doc_id", "row_key", "n", "rel", "starts", "times"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", text_key(F.col("text")).alias("row_key"), "text")
    return map_batches(rows.where(F.octet_length("text") >= length), find, f"h long, digest binary, doc_id {kind}, row_key long, n int, rel int, starts {_STARTS}, times long")


def with_text(wanted: DataFrame, docs: DataFrame, how: str = "inner") -> DataFrame:
    """`wanted` (one row per doc_id and row_key, nested columns only besides) with the text."""
    text = docs.select(F.col("doc_id").alias("_d"), text_key(F.col("text")).alias("_k"), "text").where("text IS NOT NULL")
    return wanted.join(text, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row_key") == F.col("_k")), how)


_CONTEXT = "g long, h long, digest binary, first int, weight long, n int, rel int, data binary"
_CONTEXT_NAMES = ["g", "h", "digest", "first", "weight", "n", "rel", "data"]
_CONTEXT_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_CONTEXT_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _CONTEXT_TYPES, strict=True)], names=_CONTEXT_NAMES)


def context_bytes(distinct: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The bytes of distinct contexts, each read from one document that holds it.

    Rows: g (whose contexts meet in one task), h and digest (of the context), first (its first
    window here), weight, n (windows), rel (of the anchor), data.
    """
    wanted = distinct.groupBy("at.doc_id", "at.row_key").agg(F.collect_list(F.struct("h", "digest", "weight", "at.n", "at.rel", "at.start")).alias("parts"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for parts, text in zip(batch.column("parts").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            rows += [(p["h"], p["h"], p["digest"], 0, p["weight"], p["n"], p["rel"], data[p["start"] : p["start"] + p["n"] + length - 1]) for p in parts]
        return _context_batch(rows)

    return map_batches(with_text(wanted, docs).select("parts", "text"), cut, _CONTEXT)


def split_contexts(contexts: DataFrame, length: int, gram: int, seed: int) -> DataFrame:
    """Contexts cut where a second anchor, of another hash, changes; equal windows get equal groups."""

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for g, h, digest, first, weight, _, _, data in zip(*(batch.column(c).to_pylist() for c in _CONTEXT_NAMES), strict=True):
            hashes, anchors, lows, highs = anchor_runs(np.frombuffer(data, dtype=np.uint8), length, gram, seed)
            groups = _mixed((hashes ^ _U64(g & (1 << 64) - 1)) * _U64(0xC2B2AE3D27D4EB4F)).view(np.int64)
            for k, a, low, high in zip(groups.tolist(), anchors.tolist(), lows.tolist(), highs.tolist(), strict=True):
                rows.append((k, h, digest, first + low, weight, high - low + 1, a - low, data[low : high + length]))
        return _context_batch(rows)

    return map_batches(contexts.select(*_CONTEXT_NAMES), split, _CONTEXT)


# --- suffix order -----------------------------------------------------------------------------


def suffix_array(symbols: list[int]) -> list[int]:
    """Suffix order of `symbols` (integers from 1 on), by linear grouping; an end below all is implied."""
    n = len(symbols)
    if not n:
        return []
    text = [*symbols, 0]
    n += 1
    slots = np.argsort(np.asarray(text), kind="stable").tolist()  # suffixes, group by group
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for k, s in enumerate(slots):
        if k and text[s] != text[slots[k - 1]]:
            start = k
        place[s], group[s] = k, start
        size[start] += 1

    # Descending groups: pointers to the previous suffix of a lower group; the pointed-to move up.
    previous = [-1] * n
    end = n
    while end:
        low = group[slots[end - 1]]
        if end - low == 1:
            s = slots[low]
            j = s - 1
            while j >= 0 and group[j] > low:
                j = previous[j]
            previous[s] = j
            if j >= 0:
                old = group[j]
                if size[old] > 1:
                    last = old + size[old] - 1
                    at, other = place[j], slots[last]
                    slots[at], slots[last] = other, j
                    place[other], place[j] = at, last
                    size[old] -= 1
                    group[j], size[last] = last, 1
            end = low
            continue
        members = sorted(slots[low:end])
        times: dict[int, int] = {}
        for s in members:
            j = s - 1
            while j >= 0 and group[j] >= low:
                j = previous[j]
            previous[s] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, k in times.items():
            by_count.setdefault(k, []).append(j)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for j in by_count[k]:
                moved.setdefault(group[j], []).append(j)
            for old, js in moved.items():
                if len(js) == size[old]:
                    continue  # the whole group moves behind nothing
                last = old + size[old]
                for j in js:
                    last -= 1
                    at, other = place[j], slots[last]
                    slots[at], slots[last] = other, j
                    place[other], place[j] = at, last
                size[old] -= len(js)
                size[last] = len(js)
                for j in js:
                    group[j] = last
        end = low

    # Ascending order: each placed suffix places those that its pointers reach, at the front of their groups.
    order, free, done = [-1] * n, {}, [False] * n
    order[0], done[n - 1] = n - 1, True
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            at = free.get(g, g)
            order[at], done[j] = j, True
            free[g] = at + 1
            j = previous[j]
    return order[1:]


# --- equal windows in a task ----------------------------------------------------------------------


def repeated_windows(contexts: list[tuple[int, int, int, bytes]], length: int = LENGTH, block: int = BLOCK) -> list[np.ndarray]:
    """Of contexts (weight, n, rel, data), the window numbers that are repeated among them.

    rel is where the anchor stands in data; windows start at 0 .. n - 1.
    """
    if length % block or not contexts:
        raise ValueError("the block must divide the length, and there must be contexts")
    weight, n, rel = (np.asarray([c[k] for c in contexts], dtype=np.int64) for k in range(3))
    data = np.frombuffer(b"".join(c[3] for c in contexts), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(c[3]) for c in contexts])])
    shift = rel % block  # the first block boundary of a context
    blocks = (np.diff(starts) - shift) // block
    first = np.concatenate([[0], np.cumsum(blocks + 1)])  # in the block text, with a separator after each context
    own = np.repeat(np.arange(len(contexts)), blocks)
    at = starts[own] + shift[own] + block * (np.arange(len(own)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    cells = np.lib.stride_tricks.sliding_window_view(data, block)[at]
    symbol = np.unique(np.ascontiguousarray(cells).view(np.dtype((np.void, block))).reshape(-1), return_inverse=True)[1].reshape(-1) + 2
    text = np.ones(first[-1], dtype=np.int64)
    text[np.arange(len(own)) + own] = symbol

    order = np.asarray(suffix_array(text.tolist()), dtype=np.int64)
    whole = length // block - 1
    padded = np.concatenate([text, np.zeros(whole, dtype=np.int64)])
    same = np.ones(len(order) - 1, dtype=bool)
    for k in range(whole):
        same &= padded[order[1:] + k] == padded[order[:-1] + k]
    interval = np.empty(len(order), dtype=np.int64)
    interval[order] = np.concatenate([[0], np.cumsum(~same)])

    owner = np.repeat(np.arange(len(contexts)), n)
    x = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    number = -(-np.maximum(x - shift[owner], 0) // block)  # of the first whole block in the window
    head = shift[owner] + block * number - x
    held = interval[first[owner] + number]
    edges = np.empty((len(owner), block), dtype=np.uint8)
    column = np.arange(block)
    for low in range(0, len(owner), EDGE_ROWS):
        part = slice(low, low + EDGE_ROWS)
        p = starts[owner[part]] + x[part]
        edges[part] = data[p[:, None] + column + np.where(column < head[part][:, None], 0, length - block)]
    words = edges.view(_U64)
    key = _mixed(held.astype(_U64) * _U64(0x9E3779B97F4A7C15) + head.astype(_U64))
    for k in range(words.shape[1]):
        key = _mixed((key ^ words[:, k]) * _U64(0xD6E8FEB86659FD93))
    turn = np.argsort(key, kind="stable")
    equal = (held[turn[1:]] == held[turn[:-1]]) & (head[turn[1:]] == head[turn[:-1]]) & (words[turn[1:]] == words[turn[:-1]]).all(1)
    run = np.concatenate([[0], np.cumsum(~equal)])
    total = np.bincount(run, weights=weight[owner[turn]])
    repeated = np.zeros(len(owner), dtype=bool)
    repeated[turn] = total[run] > 1.5
    return [x[a:b][repeated[a:b]] for a, b in zip(np.cumsum(n) - n, np.cumsum(n), strict=True)]


def _ranges(numbers: np.ndarray) -> list[dict]:
    if not len(numbers):
        return []
    cuts = np.flatnonzero(np.diff(numbers) > 1)
    return [{"a": int(a), "b": int(b)} for a, b in zip(numbers[np.concatenate([[0], cuts + 1])], numbers[np.concatenate([cuts, [len(numbers) - 1]])], strict=True)]


_RANGE = "array<struct<a: int, b: int>>"
_FOUND = f"h long, digest binary, ranges {_RANGE}"
_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def sorted_contexts(contexts: DataFrame, length: int, block: int) -> DataFrame:
    """Repeated windows of contexts, from one suffix array per run of groups: rows (h, digest, ranges)."""
    ensure_importable(contexts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solved() -> pa.RecordBatch:
            found = repeated_windows([r[4:] for r in held], length, block) if held else []
            keep = [(r[1], r[2], _ranges(w + r[3])) for r, w in zip(held, found, strict=True) if len(w)]
            columns = list(zip(*keep, strict=True)) if keep else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], _RANGES)], names=["h", "digest", "ranges"])

        size = 0
        for whole in batches:
            step = max(1, int(whole.num_rows * BATCH_BYTES / max(whole.nbytes, 1)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                for row in zip(*(batch.column(c).to_pylist() for c in _CONTEXT_NAMES), strict=True):
                    if size > SORT_BYTES and row[0] != held[-1][0]:
                        yield solved()
                        held, size = [], 0
                    held.append(row)
                    size += len(row[-1])
        yield solved()

    return contexts.select(*_CONTEXT_NAMES).repartition("g").sortWithinPartitions("g").mapInArrow(run, _FOUND)


def counted_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same for what still crowds after all splits: every window is counted by its digest."""

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        h, digest, weight, number, key = [], [], [], [], []
        for _, a, d, first, w, n, _, data in zip(*(batch.column(c).to_pylist() for c in _CONTEXT_NAMES), strict=True):
            h += [a] * n
            digest += [d] * n
            weight += [w] * n
            number += range(first, first + n)
            key += [xxhash.xxh3_128_digest(data[i : i + length]) for i in range(n)]
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(digest, pa.binary()), pa.array(weight, pa.int64()), pa.array(number, pa.int32()), pa.array(key, pa.binary())], names=["h", "digest", "weight", "number", "key"])

    rows = map_batches(contexts, windows, "h long, digest binary, weight long, number int, key binary")
    again = rows.groupBy("key").agg(F.sum("weight").alias("total")).where("total > 1").select("key")
    held = rows.join(again, "key").groupBy("h", "digest").agg(F.sort_array(F.collect_list("number")).alias("numbers"))
    one = F.transform("numbers", lambda i: F.struct(i.alias("a"), i.alias("b")))
    return held.select("h", "digest", one.cast(_RANGE).alias("ranges"))


# --- the whole operator ---------------------------------------------------------------------------


def repeats_of(contexts: DataFrame, length: int, gram: int, block: int, hot: int) -> DataFrame:
    """Rows (h, digest, ranges) of contexts (materialised), whose crowded groups are split until they are not."""
    found: DataFrame | None = None
    for seed in range(1, SPLITS + 2):
        crowded = checkpoint(contexts.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("g"))
        calm, crowd = (contexts, None) if not crowded.head(1) else (contexts.join(broadcast_if_small(crowded), "g", how) for how in ("left_anti", "left_semi"))
        part = sorted_contexts(calm, length, block)
        found = part if found is None else found.union(part)
        if crowd is None:
            return found
        if seed > SPLITS:
            return found.union(counted_windows(crowd, length))
        contexts = written(split_contexts(crowd, length, gram, seed))
    raise AssertionError("not reached")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """Per document with repeated windows: doc_id, row_key, ranges (first and last start, overlapping or not)."""
    anchors = written(anchored(docs, length, gram))
    shared = anchors.groupBy("h").agg(F.sum("times").alias("all")).where("all > 1").select("h")
    occurrences = written(anchors.join(shared, "h", "left_semi"))
    discard(anchors)
    one = F.struct("doc_id", "row_key", F.col("starts")[0]["at"].alias("start"), "n", "rel")
    distinct = occurrences.groupBy("h", "digest").agg(F.sum("times").alias("weight"), F.min(one).alias("at"))
    contexts = written(context_bytes(distinct, docs, length))
    found = repeats_of(contexts, length, gram, block, hot)
    back = occurrences.select("h", "digest", "doc_id", "row_key", "starts").join(found, ["h", "digest"])
    span = lambda s, r: F.struct((s["at"] + r["a"]).alias("a"), (s["at"] + (s["n"] - 1) * s["step"] + r["b"]).alias("b"))
    spans = F.flatten(F.transform("starts", lambda s: F.transform("ranges", lambda r: span(s, r))))
    return back.select("doc_id", "row_key", spans.alias("spans")).groupBy("doc_id", "row_key").agg(F.flatten(F.collect_list("spans")).alias("ranges"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    docs = docs.select("doc_id", "text")
    ranges = repeated_ranges(docs, length, gram, block, hot).select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k"), "ranges")
    joined = docs.join(ranges, docs["doc_id"].eqNullSafe(F.col("_d")) & (text_key(docs["text"]) == F.col("_k")), "left").select("doc_id", "text", "ranges")

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, spans, kept = [], [], [], []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            gone, n, left, last = 0, 0, [], 0
            stop = start = -1
            for a, b in [*sorted((r["a"], r["b"] + length) for r in ranges or ()), (len(data) + 1, -1)]:
                if a > stop:
                    if stop > start:
                        gone, n = gone + stop - start, n + 1
                        left.append(data[last:start])
                        last = stop
                    start, stop = a, b
                else:
                    stop = max(stop, b)
            left.append(data[last:])
            sizes.append(len(data))
            removed.append(gone)
            spans.append(n)
            kept.append(b"".join(left))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in (sizes, removed, spans)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_batches(joined, strip, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept binary")

