from __future__ import annotations

import random
import zlib
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import pytest

from lodegraph.llm import window_packing as W


def test_combinations_fill_the_window():
    for window, lengths in ((12, [1, 2, 3, 5, 6, 7, 11]), (9, [3]), (10, [4])):
        expected = {tuple(sorted(c, reverse=True)) for c in combinations_with_replacement([0, *lengths], 3) if sum(c) == window}
        assert set(map(tuple, W.combinations(np.asarray(lengths), window).tolist())) == expected


def test_repeat_counts_are_the_least_squares_of_a_histogram_that_can_be_used_up():
    rng, window = np.random.default_rng(0), 32
    parts = W.combinations(np.arange(1, window), window)
    truth = np.zeros(len(parts))
    truth[rng.choice(len(parts), 12, replace=False)] = rng.integers(1, 50, 12)
    histogram = np.bincount(parts.ravel(), weights=np.repeat(truth, 3), minlength=window + 1)
    histogram[0] = 0
    repeats = W.repeat_counts(parts, histogram, tolerance=0)
    used = np.bincount(parts.ravel(), weights=np.repeat(repeats, 3), minlength=window + 1)
    assert (repeats >= 0).all()
    assert np.abs(used[1:] - histogram[1:]).max() < 1e-4 * histogram.max()
    # Where it can't be used up, no combination may lower the error and those in use can't be improved.
    histogram = rng.integers(0, 40, window + 1).astype(float)
    histogram[0] = 0
    repeats = W.repeat_counts(parts, histogram, tolerance=0)
    missing = histogram - np.bincount(parts.ravel(), weights=np.repeat(repeats, 3), minlength=window + 1)
    missing[0] = 0
    gain = missing[parts].sum(axis=1)
    assert gain.max() < 1e-3 * histogram.max()
    assert np.abs(gain[repeats > 1e-6]).max() < 1e-3 * histogram.max()


@pytest.mark.parametrize("seed", range(30))
def test_plan_fills_its_windows_and_accounts_for_every_remainder(seed):
    rng = random.Random(seed)
    window = rng.choice([2, 5, 16, 64])
    histogram = Counter(rng.randint(1, window - 1) for _ in range(rng.choice([0, 1, 30, 500])))
    runs, left, sequences = W.plan(histogram, window)
    ranks, filled = Counter(), {}
    for length, first, n, sequence, each, base in sorted(runs):
        for k in range(n):
            filled.setdefault(sequence + k // each, []).append((base + k % each * length, length))
        assert first == ranks[length]
        ranks[length] += n
    assert sorted(filled) == list(range(sequences))
    for places in filled.values():
        at = 0
        for start, length in sorted(places):
            assert start == at
            at += length
        assert at == window
    assert {k: v for k, v in histogram.items() if ranks[k] < v} == {k: histogram[k] for k in left}
    assert all(left[k] == ranks[k] for k in left)


def test_rank_file_gives_the_tokenizers_ids():
    tokenizer = W.byte_tokenizer()
    rng = random.Random(0)
    usual, every = [chr(i) for i in [*range(1, 0x250)]], [chr(i) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 60))) for pool in (usual, every, list(" \n\t'sdtlvrem1a.")) for _ in range(1500)]
    texts += ["a<|endoftext|>b", "", "it's we're I'd ''s  's's", "x" * 3000, " " * 500, "中" * 500]
    for text in texts:
        assert tokenizer.encode(text) == np.asarray(tokenizer.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def check(rows, texts, window):
    """Pieces tile each document's ids; sequences are gapless; only sequences of whole windows or powers of two occur."""
    tokenizer = W.byte_tokenizer()
    documents = Counter()
    for doc_id, text in texts:
        documents[doc_id, tokenizer.encode(text or "") + b"\0\0\0\0"] += 1
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    expected = {}
    for (doc_id, ids), n in documents.items():
        expected.setdefault(doc_id, []).extend([ids] * n)
    assert by_doc.keys() == expected.keys()
    for doc_id, copies in expected.items():
        assert sum(p[1] for p in by_doc[doc_id]) == sum(len(i) // 4 for i in copies)
        if len(copies) == 1:
            at = 0
            for start, length, crc, total in sorted(by_doc[doc_id]):
                assert (start, total) == (at, len(copies[0]) // 4)
                assert crc == zlib.crc32(copies[0][4 * start : 4 * (start + length)])
                at += length
            assert at == len(copies[0]) // 4
    for places in sequences.values():
        at = 0
        for start, length in sorted(places):
            assert start == at
            at += length
        assert at == window or at < window and at & (at - 1) == 0
    return len(rows)


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_pack_windows(spark, broadcast_rows, monkeypatch):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choices(["the", "house", "Unbelievable!", "42", "naïve"], k=rng.randint(0, 60)))) for i in range(60)] + [(99, None), (100, ""), (101, "word " * 500), (101, "word " * 500), (None, "no id")]
    df = spark.createDataFrame([(*t, 5, 6, 7) for t in texts], "doc_id long, text string, piece int, sequence_id int, LENGTH int")
    pieces = W.written(W.token_pieces(df, 64).withColumn("_uid", W.F.monotonically_increasing_id()))
    check(W.pack_pieces(pieces, 64, ranked=3, broadcast_rows=broadcast_rows).collect(), texts, 64)
    assert W.pack_windows(df.limit(0)).collect() == []


def test_one_length_only(spark):
    texts = [(i, "a b c") for i in range(50)]
    check(W.pack_windows(spark.createDataFrame(texts, "doc_id long, text string"), 16).collect(), texts, 16)


def test_query(spark, sf_dir):
    from lodegraph.llm.queries import op13_window_packing

    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = op13_window_packing(spark, sf_dir).collect()
    check(rows, texts, 1024)
