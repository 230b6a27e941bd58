from __future__ import annotations

import random

import pytest

from lodegraph.llm import decontamination as dc


def distance(pattern, text):
    """Least edit distance to a substring, and the first end that has it."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row), row.index(min(row))


@pytest.mark.parametrize("seed", range(20))
def test_myers(seed):
    rng = random.Random(seed)
    for _ in range(50):
        p, t = ("".join(rng.choices("abc", k=rng.randint(lo, hi))) for lo, hi in ((1, 90), (0, 120)))
        assert dc.myers(p, t) == distance(p, t)


@pytest.mark.parametrize("seed", range(10))
def test_nothing_within_the_budget_is_missed(seed):
    rng = random.Random(seed)
    items = [(i, "".join(rng.choices("abcd ", k=rng.randint(40, 80)))) for i in range(4)]
    matcher = dc.Matcher(items, rate=0.1)
    for _ in range(30):
        text = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choices("xyz", k=rng.randint(0, 1))
        whole = "".join(rng.choices("efg \n", k=50)) + "".join(text) + "".join(rng.choices("efg", k=50))
        normal = dc.normal(whole)
        expected = {i: distance(dc.normal(t), normal)[0] for i, t in items if distance(dc.normal(t), normal)[0] <= int(0.1 * len(dc.normal(t)))}
        assert {h["item_id"]: h["distance"] for h in matcher.find(whole)} == expected


def test_items_without_a_budget_must_stand_whole():
    matcher = dc.Matcher([(1, "cat sat on"), (2, "C++"), (3, "")])
    assert [h["item_id"] for h in matcher.find("The  CAT\nsat on.")] == [1]
    assert matcher.find("a bobcat sat on it, a cat sat once") == []
    hit = matcher.find("in c++ only")[0]
    assert (hit["item_id"], hit["distance"], hit["start"], hit["end"]) == (2, 0, 3, 6)


@pytest.mark.parametrize("seed", range(10))
def test_items_of_ten_to_sixty_characters_with_edits(seed):
    rng = random.Random(seed)
    items = [(i, "".join(rng.choices("abcd ", k=n))) for i, n in enumerate(range(10, 61, 5))]
    items = [(i, t) for i, t in items if dc.normal(t)]
    matcher = dc.Matcher(items)
    for _ in range(40):
        text = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choices("xyz", k=rng.randint(0, 1))
        whole = rng.choice(["e", ". ", ""]) + "".join(text) + rng.choice([" f", "!", ""])
        normal, expected = dc.normal(whole), {}
        for i, t in items:
            item = dc.normal(t)
            budget, best = int(dc.RATE * len(item)), distance(item, normal)[0]
            if budget and best <= budget or not budget and any(normal.startswith(item, k) and dc.Matcher._stands_alone(normal, k, k + len(item)) for k in range(len(normal))):
                expected[i] = best
        assert {h["item_id"]: h["distance"] for h in matcher.find(whole)} == expected


def test_query_against_brute_force_with_edits(spark, sf_dir):
    """Every document and item of the smallest tables, by the plain recurrence over the text's words around a shared word run."""
    from lodegraph.llm.queries import op8_decontamination

    items = [(r.item_id, dc.normal(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = [(r.doc_id, dc.normal(r.text or "")) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text or "") < 1500][:40]
    found = {(r.doc_id, r.item_id): r.distance for r in op8_decontamination(spark, sf_dir).collect()}
    for d, t in texts:
        for i, x in items[:10]:
            best = dc.myers(x, t)[0]  # held against the plain recurrence in test_myers
            assert found.get((d, i)) == (best if best <= int(dc.RATE * len(x)) else None)


def test_search(spark):
    item = "The quick brown fox jumps over the lazy dog near the quiet river bank"
    edited = item.replace("quick", "quik").upper().replace(" ", "\n  ")
    rows = [(1, f"é. {item} end"), (1, f"é. {item} end"), (None, f"xx {edited}"), (2, None), (3, ""), (4, "clean " * 50_000), (5, item[: len(item) // 2])]
    docs = spark.createDataFrame([(*r, "h") for r in rows], "doc_id long, text string, hits string")
    bench = spark.createDataFrame([(7, item), (8, item), (9, None), (10, "a short item"), (None, "")], "item_id long, text string")
    found = dc.leaks(docs, bench).collect()
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in found), key=str) == sorted([(1, 7, 0), (1, 8, 0)] * 2 + [(None, 7, 1), (None, 8, 1)], key=str)
    assert {(r.start, r.end) for r in found if r.doc_id == 1} == {(3, 3 + len(item))}
    assert {r.doc_id for r in dc.clean(docs, bench).collect()} == {2, 3, 4, 5}
    assert {tuple(r) for r in dc.leaks(docs, bench).collect()} == {tuple(r) for r in dc.search(docs, bench, block_chars=30, held_bytes=50).selectExpr("doc_id", "inline(hits)").collect()}
    plan = dc.search(docs, bench, block_chars=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert dc.leaks(docs, bench.limit(0)).collect() == dc.leaks(docs.limit(0), bench).collect() == []


def test_query_finds_every_verbatim_item(spark, sf_dir):
    from lodegraph.llm.queries import op8_decontamination

    docs = [(r.doc_id, dc.normal(r.text or "")) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, dc.normal(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id) for r in op8_decontamination(spark, sf_dir).collect()}
    assert {(d, i) for d, t in docs for i, x in items if x in t} <= found
    texts = dict(docs)
    for d, i in list(found)[:10]:
        assert distance(dict(items)[i], texts[d])[0] <= int(dc.RATE * len(dict(items)[i]))
