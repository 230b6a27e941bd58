from __future__ import annotations

import random
from collections import Counter

import pytest

from lodegraph.llm import suffix_dedup as sd


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array(seed):
    rng = random.Random(seed)
    for _ in range(60):
        text = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 40))] * rng.choice([1, 1, 3])
        assert sd.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def corpus():
    rng = random.Random(3)
    base = ["".join(rng.choices("abé ", k=rng.randint(0, 700))) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(base)
            low = rng.randint(0, len(t))
            parts.append(t[low : rng.randint(low, len(t))] if rng.random() < 0.7 else "".join(rng.choices("xyz", k=rng.randint(0, 150))))
        texts.append("".join(parts))
    return [*texts, None, "", "a" * 900, "ab" * 500, "De " * 400, base[0], base[0], "q" * 399, "q" * 400]


@pytest.mark.parametrize(("length", "gram", "block", "hot"), [(40, 16, 8, 10_000), (40, 8, 40, 10_000), (40, 16, 8, 1), (400, 128, 40, 8192)])
def test_against_brute_force(spark, length, gram, block, hot):
    texts = corpus()
    df = spark.createDataFrame([(i % 30 or None, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, row_key int, ranges int")
    rows = sd.remove_repeats(df, length, gram, block, hot).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows) == brute(texts, length)


def test_empty(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, sf_dir):
    from hashlib import sha256

    from lodegraph.llm.queries import op4_suffix_dedup

    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = op4_suffix_dedup(spark, sf_dir).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == sorted((*x[:3], sha256(x[3]).hexdigest()) for x in brute(texts, 400))


def test_periodic_texts_are_kept_as_runs(spark):
    data = "a" * 300_000 + "b" + "xy" * 20_000
    runs = [r for _, _, _, starts in sd.contexts_of(data.encode()).values() for r in starts]
    assert sum(r[2] for r in runs) > 300_000 and len(runs) < 2_000
    rows = sd.remove_repeats(spark.createDataFrame([(1, data), (2, data)], "doc_id long, text string")).collect()
    assert [(r.n_removed, r.n_spans, bytes(r.kept)) for r in rows] == [(len(data), 1, b"")] * 2
