from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lodegraph.llm import jaccard_join as jj


def shingles(text):
    words = (text or "").lower().split()
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
                if sets[a] != sets[b]:
                    links[a].add(sets[b])
                    links[b].add(sets[a])
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append(d)
    key = lambda d: (d is None, d or 0)
    return [(d, min(least[root(i)], key=key) if sets[i] else d, len(links[i]), sum(s == sets[i] for s in sets) if sets[i] else 1) for i, (d, _) in enumerate(rows)]


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, row_key int, set_id int")
    return sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in jj.near_duplicates(df, **options).collect()), key=str)


def corpus(rng, groups, copies, edits):
    rows, words = [], [f"w{i}" for i in range(400)]
    for _ in range(groups):
        base = rng.choices(words, k=rng.randint(40, 90))
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    return rows


def test_against_brute_force(spark):
    rows = corpus(random.Random(0), 40, 5, 3)
    rows += [(1000, None), (1001, ""), (1002, "only four words here"), (1003, "Only four  words HERE"), (None, rows[3][1]), (5, rows[5][1]), (1004, "long " * 30_000)]
    assert found(spark, rows) == sorted(brute(rows), key=str)


def test_a_large_group_of_near_copies_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_SETS", 50)
    rows = corpus(random.Random(1), 3, 4, 1) + [(10_000 + d, t) for d, t in corpus(random.Random(2), 1, 1, 0)]
    base, rng = rows[-1][1].split(), random.Random(3)
    for k in range(220):
        text = list(base)
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(50)}"
        rows.append((20_000 + k, " ".join(text)))
    assert found(spark, rows) == sorted(brute(rows), key=str)


def test_one_row_of_each_class_stays(spark):
    rows = [(3, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (2, None), (4, "z y x w v")]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    assert sorted(jj.without_near_duplicates(df).collect()) == [(1, rows[1][1], "en"), (2, None, "en"), (4, "z y x w v", "en")]
    assert jj.without_near_duplicates(df.limit(0)).collect() == []


def test_runs_reach_the_recall():
    assert jj.runs_needed(0.8, 0.999) > jj.runs_needed(0.9, 0.999) >= 1


def test_runs_reach_the_recall_at_full_depth():
    for threshold in (0.7, 0.8, 0.9):
        runs = jj.runs_needed(threshold)
        assert jj.missed(runs, threshold, jj.DEPTH) <= 1 - jj.RECALL < jj.missed(runs - 1, threshold, jj.DEPTH)
    with pytest.raises(ValueError):
        jj.runs_needed(0.8, 0.999999)


def test_pairs_meet_as_often_as_stated_when_nodes_go_deep():
    """Pairs of signatures at the threshold descend the operator's own paths; those that part in every run are missed."""
    pairs, rng = 20_000, np.random.default_rng(0)
    same = rng.random((pairs, jj.COORDINATES)) < jj.THRESHOLD
    sigs = rng.integers(0, 1 << 32, (pairs, jj.COORDINATES), dtype=np.uint64)

    def parted(runs):
        paths, pair = [], []
        for at in jj.root_coordinates(runs):
            on = np.flatnonzero(same[:, at])
            paths.append(jj.child_paths(np.zeros(len(on), np.uint64), sigs[on], np.full(len(on), at)))
            pair.append(on)
        for _ in range(jj.DEPTH - 1):
            held_paths, held_pair = np.concatenate(paths), np.concatenate(pair)
            paths, pair = [], []
            for at in jj.chosen_coordinates(held_paths):
                on = np.flatnonzero(same[held_pair, at])
                paths.append(jj.child_paths(held_paths[on], sigs[held_pair[on]], at[on]))
                pair.append(held_pair[on])
        return 1 - len(np.unique(np.concatenate(pair))) / pairs

    assert parted(jj.runs_needed()) <= 1.5 * (1 - jj.RECALL)
    assert abs(parted(1) - jj.missed(1)) < 0.015


def exact_classes(rows, threshold=0.8):
    """Classes and linked pairs of distinct sets, by an inverted index on the rarest shingles: exact, without hashing."""
    distinct = {}
    for i, (_, text) in enumerate(rows):
        if sh := shingles(text):
            distinct.setdefault(sh, []).append(i)
    sets, frequency = list(distinct), Counter(s for sh in distinct for s in sh)
    ordered = [sorted(sh, key=lambda s: (frequency[s], s)) for sh in sets]
    index, links, parent = defaultdict(list), [0] * len(sets), list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pairs = 0
    for a in sorted(range(len(sets)), key=lambda k: len(sets[k])):
        n, seen = len(sets[a]), set()
        for s in ordered[a][: n - math.ceil(threshold * n) + 1]:
            for b in index[s]:
                if b not in seen and len(sets[b]) >= threshold * n:
                    seen.add(b)
                    if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                        pairs, parent[root(a)] = pairs + 1, root(b)
                        links[a], links[b] = links[a] + 1, links[b] + 1
            index[s].append(a)
    least = defaultdict(list)
    for a, sh in enumerate(sets):
        least[root(a)] += [rows[i][0] for i in distinct[sh]]
    out = {d: (d, 0) for d, t in rows}
    for a, sh in enumerate(sets):
        for i in distinct[sh]:
            out[rows[i][0]] = (min(least[root(a)]), links[a])
    return out, pairs


def test_the_supplied_table_against_exact_pairs(spark):
    """Recall on whole documents: every class and link count of the registered query."""
    from lodegraph.llm.queries import ORACLE_SQL, op5_jaccard_join

    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected, pairs = exact_classes(rows)
    assert pairs >= 5
    found = op5_jaccard_join(spark, sf_dir).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == expected
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    stated = duck.sql(ORACLE_SQL["op5_jaccard_join"])
    at = [stated.columns.index(c) for c in ("doc_id", "class_id", "n_links", "n_copies")]
    assert sorted((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in found) == sorted(tuple(x[i] for i in at) for x in stated.fetchall())


def test_a_node_with_few_sets_outside_its_hubs_reach(spark, monkeypatch):
    """A crowd around one text, and some texts that share a part of it: ties are found without descending for ever."""
    monkeypatch.setattr(jj, "BUCKET", 8)
    rng, rows = random.Random(5), []
    base = [f"b{i}" for i in range(80)]
    for k in range(120):
        text = list(base)
        for _ in range(rng.randint(1, 3)):
            text[rng.randrange(len(text))] = f"x{k}"
        rows.append((k, " ".join(text)))
    for k in range(60):
        text = base[: rng.randint(20, 60)] + [f"y{k // 2}z{i}" for i in range(60)]
        rows.append((1000 + k, " ".join(text)))
    assert found(spark, rows) == sorted(brute(rows), key=str)


def crowd(n, shared, own):
    """Texts that begin with the same words and go on with their own: all alike to some degree, none near copies."""
    return [(k, " ".join([f"c{i}" for i in range(shared)] + [f"w{k}x{i}" for i in range(own)])) for k in range(n)]


def test_a_crowd_that_shares_a_passage_does_not_descend(spark, monkeypatch):
    """A few hundred sets are compared where they stand; each level that they would descend holds most of them again."""
    levels, descend = [], jj.next_nodes
    monkeypatch.setattr(jj, "next_nodes", lambda nodes: levels.append(nodes.count()) or descend(nodes))
    rows = crowd(400, 60, 60)
    rows += [(1000 + k, f"{rows[k][1]} one more") for k in range(0, 400, 10)]
    assert found(spark, rows) == sorted(brute(rows), key=str)
    assert levels == []


def test_rows_follow_the_size_of_a_crowd(spark, monkeypatch):
    """What large nodes hand down grows with a crowd, not with its square, and links between its texts are found at any size."""
    monkeypatch.setattr(jj, "BUCKET", 16)
    descend, handed = jj.next_nodes, []
    monkeypatch.setattr(jj, "next_nodes", lambda nodes: handed.append(nodes.count()) or descend(nodes))
    total = []
    for n in (200, 400):
        handed.clear()
        rows = crowd(n, 30, 60)
        rows += [(1000 + k, f"{rows[k][1]} one more") for k in range(0, n, 10)]
        assert found(spark, rows) == sorted(brute(rows), key=str)
        total.append(sum(handed))
    assert 0 < total[1] <= 3 * total[0]


def test_least_tied_members():
    rng = np.random.default_rng(0)
    for n in (1, 2, 30, 90):
        near = rng.random((n, n)) < 1.2 / n
        near |= near.T
        parent = {i: i for i in range(n)}
        jj._forest(parent, zip(*np.nonzero(np.triu(near, 1)), strict=True))
        assert jj.least_tied(near).tolist() == list(parent.values())
    chain = np.eye(40, k=1, dtype=bool) | np.eye(40, k=-1, dtype=bool)
    assert not jj.least_tied(chain).any()
