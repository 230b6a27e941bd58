from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from lodegraph.llm import quality_rules


def brute(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_features_against_brute_force():
    rng = random.Random(0)
    texts = [None, "", " \n\x0b ", "a\x1cb\xa0c\x85d　e", "x " * 5000]
    texts += ["".join(rng.choices(["a ", "b ", "c\n", "#x ", "\xa0", "\t", "AB! "], k=rng.randint(0, 60))) for _ in range(500)]
    for text in texts:
        assert quality_rules.features_of(text)[:5] == brute(text)


def test_binomial_is_exact():
    for n, p in ((1, 0.3), (50, 0.01), (700, 0.003)):
        for k in range(0, n, max(1, n // 7)):
            assert quality_rules.binomial_below(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), abs=1e-9)


def test_certified_cutoff_is_the_strictest_that_holds():
    counts = {0: 9000, 1: 900, 2: 40, 3: 20, 40: 20, 64: 20}
    n, risk, level = sum(counts.values()), 0.005, 0.01
    cut = quality_rules.certified_bin(counts.items(), n, risk, level)
    rejected = lambda c: sum(v for b, v in counts.items() if b > c)
    assert quality_rules.binomial_below(rejected(cut), n, risk) <= level < quality_rules.binomial_below(rejected(cut - 1), n, risk)
    assert quality_rules.certified_bin({0: 20}.items(), 20, risk, level) is None


def test_guarantee_over_many_draws():
    """Cutoffs calibrated on samples reject more than the risk in no more than the error rate of draws."""
    rng, broken = random.Random(5), 0
    for _ in range(60):
        counts = Counter(min(64, int(rng.expovariate(0.5))) for _ in range(2000))
        cut = quality_rules.certified_bin(counts.items(), 2000, 0.02, 0.05)
        broken += math.exp(-0.5 * (cut + 1)) > 0.02
    assert broken <= 8


def test_judge(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta"]
    good = [(i, " ".join(rng.choices(words, k=60)), "en") for i in range(4000)]
    bad = [(10_000 + i, " ".join(w + "***" for w in rng.choices(words, k=60)), "en") for i in range(50)]
    rare = [(20_000 + i, " ".join(w + "***" for w in rng.choices(words, k=60)), (None, "")[i % 2]) for i in range(6)]
    edge = [(30_000, None, "en"), (30_001, "", "xx"), (None, "one two", "en"), (5, good[5][1], "en")]
    docs = spark.createDataFrame([(*r, True) for r in good + bad + rare + edge], "doc_id long, text string, lang string, kept boolean")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4000)] + [(7, 0, 0), (None, 1, 0), (8, None, 0), (99_999, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality_rules.judge(docs, labels).collect()
    assert len(rows) == 4000 + 50 + 6 + 4
    kept = {r.doc_id: r.kept for r in rows}
    assert sum(not kept[i] for i in range(4000)) <= 80
    assert not any(kept[10_000 + i] for i in range(50))
    assert all(kept[20_000 + i] for i in range(6)), "a stratum without labels rejects nothing"
    assert not kept[30_000] and not kept[30_001] and not kept[None]
    none = quality_rules.judge(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in none)
    assert quality_rules.judge(docs.limit(0), labels).collect() == []


def test_copies_of_a_good_document_count_once(spark):
    """300 copies of one good document are one draw, which certifies nothing."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text + " end" * (i % 2), "en") for i in range(300)] + [(999, "*** ### " * 5 + " ".join(f"v{i}***" for i in range(40)), "en")], "doc_id long, text string, lang string")
    rows = quality_rules.judge(docs, spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")).collect()
    assert all(r.kept for r in rows)


def test_cutoffs_on_the_supplied_tables(spark):
    """Every stratum with enough independent good labels gets a cutoff, and loses little more than its risk of all good documents."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in labels.where("quality = 1").collect()} - {r.doc_id for r in labels.where("quality = 0").collect()}
    rows = quality_rules.judge(docs, labels).select("doc_id", "stratum", "base_failed", "failed_rules").collect()
    by_rules = [r for r in rows if not r.base_failed and r.failed_rules]
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert {"en", "de", "fr", "es"} <= {r.stratum for r in by_rules}
    assert sum(r.doc_id in bad for r in by_rules) > 200
    for s in {r.stratum for r in rows}:
        own = [r for r in rows if r.stratum == s and r.doc_id in good and not r.base_failed]
        assert sum(bool(r.failed_rules) for r in own) <= 0.03 * len(own)


def test_query(spark, sf_dir):
    from lodegraph.llm.queries import op2_quality_rules

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op2_quality_rules(spark, sf_dir).collect():
        n, chars, symbols, again, repeated = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, again, repeated)
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n) and not (r.base_failed and r.kept)
