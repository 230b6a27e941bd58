from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodegraph.llm import run_detection as R


def brute(words):
    """Every maximal stretch with its smallest period, straight from the definition."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q):
                stretch = words[i : i + length]
                if not any(all(stretch[k] == stretch[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found)


def generated(rng):
    words = []
    for _ in range(rng.randint(1, 6)):
        kind, alphabet = rng.random(), rng.choice([1, 2, 3, 50])
        block = [rng.randrange(alphabet) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 30]))]
        if kind < 0.6:
            words += (block * 40)[: rng.randint(1, 6 * len(block) + 24)]
        elif kind < 0.8:
            inner = block[:3] * rng.randint(1, 12) + [99]
            words += inner * rng.randint(1, 5)
        else:
            words += block
    return words[:400]


@pytest.mark.parametrize("seed", range(400))
def test_runs_equal_brute_force(seed):
    words = generated(random.Random(seed))
    assert R.periodic_runs(np.asarray(words, dtype=np.int64)) == brute(words)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=24, max_size=160))
def test_two_words(words):
    assert R.periodic_runs(np.asarray(words)) == brute(words)


def test_hostile_texts_take_time_in_proportion():
    shapes = {
        "one word": [0] * 300_000,
        "blocks": ([0] * 100 + [1]) * 3000,
        "nested": (([0] * 20 + [1]) * 20 + [2]) * 700,
        "fibonacci": None,
        "random": np.random.default_rng(0).integers(0, 2, 300_000).tolist(),
    }
    a, b = [0], [0, 1]
    while len(b) < 300_000:
        a, b = b, b + a
    shapes["fibonacci"] = b[:300_000]
    for name, words in shapes.items():
        start = time.perf_counter()
        R.periodic_runs(np.asarray(words))
        assert time.perf_counter() - start < 30, name


def expected(doc_id, text):
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    return (
        len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest(),
    )


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_on_a_fixture(spark, tmp_path):
    from lodegraph.llm.queries import op12_run_detection

    rng = random.Random(5)
    rows = [(i, "".join(f"{rng.choice('abc')}{rng.choice([' ', '  ', chr(10), chr(9), chr(11)])}" for _ in range(rng.randint(0, 150)))) for i in range(300)]
    rows += [(300 + i, " ".join(rng.choices(["x", "yé", "z z"], k=90))) for i in range(60)]
    rows += [(1, "the same id"), (1, "the same id"), (None, "no id " * 30), (500, None), (501, ""), (502, " \n"), (503, "    " * 40), (504, " ".join("ab" * 20000))]
    spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, runs int, START int").write.parquet(str(tmp_path / "documents.parquet"))
    found = op12_run_detection(spark, str(tmp_path)).collect()
    got = sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in found), key=repr)
    short = [r for r in rows if r[0] != 504]
    want = sorted(((d, *(expected(d, t) if d is not None else expected_without_id(t))) for d, t in short), key=repr)
    assert [g for g in got if g[0] != 504] == want
    assert [g[1:4] for g in got if g[0] == 504] == [(1, 0, 40000)]
    assert op12_run_detection(spark, _empty(spark, tmp_path)).collect() == []


def expected_without_id(text):
    """A row without an id isn't rewritten."""
    return expected(next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10), text)


def _empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    return str(tmp_path / "none")


def test_query(spark, sf_dir):
    from lodegraph.llm.queries import op12_run_detection

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op12_run_detection(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    checked = 0
    for r in rows:
        if len(texts[r.doc_id] or "") < 6000:
            assert tuple(r[c] for c in COLUMNS) == expected(r.doc_id, texts[r.doc_id])
            checked += 1
    assert checked > 100
