from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lodegraph.llm import packing


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b, left in enumerate(bins) if left >= n]
        if fit:
            bins[min(fit, key=bins.__getitem__)] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_document_by_document_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 5, 16, 64, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    filled = {}
    for length, _, n, first, each, base in packing.plan_runs(Counter(lengths), capacity):
        for k in range(n):
            filled.setdefault(first + k // each, []).append((base + k % each * length, length))
    for places in filled.values():
        at = 0
        for start, length in sorted(places):
            assert start == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in filled.values()) == best_fit(lengths, capacity)


def test_words_give_the_tokenizers_ids():
    tokenizer = packing.WordTokenizer(packing.tokenizer_path())
    rng = random.Random(0)
    characters = [chr(i) for i in [*range(9, 14), *range(32, 0x260)]] + ["Σ", "İ", "ẞ", "́", "’", "中", "😀"]
    texts = ["".join(rng.choices(characters, k=rng.randint(0, 40))) for _ in range(500)] + ["a<|endoftext|>b", "", "it's we're I'd ''s 's's", "x" * 3000]
    for text, ids in zip(texts, tokenizer.encode(texts), strict=True):
        assert ids == tokenizer._whole(text)


def check_packed(rows, texts, capacity):
    tokenizer = packing.WordTokenizer(packing.tokenizer_path())
    expected, lengths = [], []
    for doc_id, text in texts:
        ids = [*np.frombuffer(tokenizer._whole(text or ""), "<u4").tolist(), 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append((doc_id, piece, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
            lengths.append(len(part))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(expected, key=repr)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for start, length in sorted(places):
            assert start == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in sequences.values()) == best_fit(lengths, capacity)


def test_pack_documents(spark):
    rng = random.Random(1)
    texts = [(i % 30 or None, " ".join(rng.choices(["the", "house", "Unbelievable!", "42", "naïve"], k=rng.randint(0, 60)))) for i in range(60)] + [(99, None), (100, ""), (101, "word " * 500), (101, "word " * 500)]
    df = spark.createDataFrame([(*t, 5, 6) for t in texts], "doc_id long, text string, piece int, sequence_id int")
    check_packed(packing.pack_documents(df, capacity=64).collect(), texts, 64)
    assert packing.pack_documents(df.limit(0)).collect() == []


def test_query(spark, sf_dir):
    from lodegraph.llm.queries import op7_packing

    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check_packed(op7_packing(spark, sf_dir).collect(), texts, 4096)
