"""Periodic runs of words by an online dynamic program over sparse diagonals.

Two words that are equal and d words apart lie on diagonal d. Words are read in order; the earlier
occurrences of each word let the match lengths of their diagonals grow by one, and a diagonal that the
next word doesn't prolong ends: if it was long enough, the run it stands for is emitted at once. Only
diagonals that are alive are held.

A word counts here with the words before it: a run of period d and of `min_exponent` periods at least
has a match of c words on its diagonal, c being the least power of two of at least 2d (16 or more), so an
earlier occurrence is one of the last c words together. Such contexts get their names by doubling, and only contexts that
repeat get one, so texts without repetition end after a few levels. Of three or more occurrences of a context between d and 2d
words back, all but the farthest repeat a shorter period (they are an arithmetic progression of the
context's own period), so at most two are followed. The work is therefore some n log n for any text, be it one
word a million times over.

A run is a maximal stretch of at least `min_length` words and `min_exponent` times its smallest period.

Defined cases: a null text has no words; a text of white space neither; very long texts are read whole; repeated rows are
judged each by itself; any column named in `keep` is returned; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import map_batches

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: Words of the shortest context; every run of 24 words and three periods has a match of as many.
CONTEXT = 16
_WORD = re.compile(r"[^ \t-\r]+")

Run = tuple[int, int, int]


def _earlier(names: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag) of earlier occurrences at lags from `low` to `high` - 1: both of two, the farthest of more."""
    at = np.flatnonzero(names >= 0)
    if not len(at):
        return at, at
    at = at[np.argsort(names[at], kind="stable")]  # by name, then position
    n = len(names)
    key = names[at] * (n + 1) + at
    own = names[at] * (n + 1)
    first = np.searchsorted(key, np.maximum(key - (high - 1), own))
    last = np.searchsorted(key, np.maximum(key - low, own - 1), side="right") - 1
    found = last >= first
    both = found & (last == first + 1)
    return np.concatenate([at[found], at[both]]), np.concatenate([at[found] - at[first[found]], at[both] - at[last[both]]])


def _contexts(names: np.ndarray, step: int) -> np.ndarray:
    """Names of contexts twice as long: the one that ends `step` words before, and the one that ends here; -1 unless it occurs twice."""
    longer = np.full(len(names), -1, dtype=np.int64)
    pair = np.flatnonzero((names[step:] >= 0) & (names[:-step] >= 0)) + step
    if len(pair):
        _, inverse, count = np.unique(names[pair - step] * (int(names.max()) + 1) + names[pair], return_inverse=True, return_counts=True)
        longer[pair] = np.where(count[inverse] > 1, inverse, -1)
    return longer


def _primitive(words: np.ndarray, start: int, period: int) -> bool:
    """Whether no divisor of `period` is a period of the two periods from `start` on."""
    block, rest, factor = words[start : start + 2 * period], period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            while rest % factor == 0:
                rest //= factor
            shorter = period // factor
            if np.array_equal(block[shorter:], block[:-shorter]):
                return False
        factor += 1
    return True


def periodic_runs(words: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """All runs (start, length, period) of a text given by the numbers of its words, by start, then period."""
    if min_exponent < MIN_EXPONENT or min_length < MIN_LENGTH:
        raise ValueError(f"runs of at least {MIN_LENGTH} words and {MIN_EXPONENT} periods are found")
    n = len(words)
    if n < min_length:
        return []
    names, size = words.astype(np.int64), 1
    while size < CONTEXT:
        names, size = _contexts(names, size), 2 * size
        if names.max() < 0:
            return []
    found = [(*_earlier(names, low, 2 * low), size) for low in (1, 2, 4, 8)]
    while 3 * size <= n and names.max() >= 0:
        names, size = _contexts(names, size), 2 * size
        found.append((*_earlier(names, size // 2, size), size))
    at = np.concatenate([a for a, _, _ in found])
    if not len(at):
        return []
    lag = np.concatenate([d for _, d, _ in found])
    context = np.concatenate([np.full(len(a), c) for a, _, c in found])
    order = np.argsort(at, kind="stable")

    runs: list[Run] = []

    def end(lag: int, match: int, at: int) -> None:
        """The diagonal's last equal word is `at`."""
        length = match + lag
        if length >= min_length and length >= min_exponent * lag and _primitive(words, at + 1 - length, lag):
            runs.append((at + 1 - length, length, lag))

    alive: dict[int, int] = {}
    now: dict[int, int] = {}
    here = -1
    for i, d, c in zip(at[order].tolist(), lag[order].tolist(), context[order].tolist(), strict=True):
        if i != here:
            for ended, match in alive.items():
                end(ended, match, here - 1)
            alive = now
            if i != here + 1:
                for ended, match in alive.items():
                    end(ended, match, here)
                alive = {}
            here, now = i, {}
        now[d] = alive.pop(d, c - 1) + 1
    for ended, match in alive.items():
        end(ended, match, here - 1)
    for ended, match in now.items():
        end(ended, match, here)
    return sorted((s, length, d) for s, length, d in runs)


def kept_words(n: int, runs: Sequence[Run]) -> np.ndarray:
    """Which words stay when each run is cut to its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def strongest(runs: Sequence[Run]) -> Run | None:
    """The run of the greatest length / period; ties go to the least start, then period."""
    best = None
    for run in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def numbered(words: list[str]) -> np.ndarray:
    numbers: dict[str, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))


def detect(docs: DataFrame, keep: Sequence[str] = ("doc_id",), min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """`keep`, n_words, runs (array of start, length, period by start, then period), best (the strongest, or null), collapsed (text of the words that stay)."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    as_row = lambda r: dict(zip(("start", "length", "period"), r, strict=True)) if r else None

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, all_runs, best, collapsed = [], [], [], []
        for text in batch.column("_text").to_pylist():
            words = _WORD.findall(text or "")
            runs = periodic_runs(numbered(words), min_length, min_exponent)
            if runs:
                stays = kept_words(len(words), runs)
                counts.append(len(words))
                words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
            else:
                counts.append(len(words))
            all_runs.append([as_row(r) for r in runs])
            best.append(as_row(strongest(runs)))
            collapsed.append(" ".join(words))
        columns = [*(batch.column(i) for i in range(len(keep))), pa.array(counts, pa.int64()), pa.array(all_runs, pa.list_(run)), pa.array(best, run), pa.array(collapsed, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "runs", "best", "collapsed"])

    names = [f"_k{i}" for i in range(len(keep))]
    frame = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col("text").alias("_text"))
    one = "struct<start: long, length: long, period: long>"
    schema = ", ".join([*(f"{n} {frame.schema[n].dataType.simpleString()}" for n in names), f"n_words long, runs array<{one}>, best {one}, collapsed string"])
    found = map_batches(frame, judge, schema)
    return found.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "n_words", "runs", "best", "collapsed")
