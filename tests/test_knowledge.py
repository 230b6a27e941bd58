"""Patterns, ten-class comparison, bounded walks, centrality and records on literal fixtures."""

from __future__ import annotations

import random
from collections import deque

import pytest

from lodegraph.functions import text
from lodegraph.operators import comparison, patterns, records, walks
from pyspark.sql import functions as F

EDGES = "edge_id string, relation string, role string, parent_end string, src string, dst string"


def graph_of(spark, rows):
    return spark.createDataFrame([(str(i), r, "flow", None, a, b) for i, (r, a, b) in enumerate(rows)], EDGES)


@pytest.mark.parametrize(
    ("pattern", "place"),
    [
        ([], "$"), ({}, "$"), ({"and": []}, "$.and"), ({"and": [{"nor": 1}]}, "$.and[0].nor"), ({"field_in": {"path": "a"}}, "$.field_in"), ({"field_equals": {"path": "", "value": 1}}, "$.field_equals.path"),
        ({"edge_exists": {"direction": "up", "relation": "r"}}, "$.edge_exists.direction"), ({"field_in": {"path": "a", "values": [[1]]}}, "$.field_in"), ({"a": 1, "b": 2}, "$"),
        ({"not": {"not": {"not": {"not": {"not": {"not": {"fact_kind_present": {"kind": "x"}}}}}}}}, "$" + ".not" * 6),
    ],
)
def test_wrong_patterns_say_where(pattern, place):
    with pytest.raises(patterns.PatternError) as error:
        patterns.validate(pattern)
    assert error.value.place == place


def test_patterns(spark):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "A")], "node_id string, kind string")
    fields = spark.createDataFrame([("a", ("x", 1), ["p", "q"]), ("b", (None, None), None), ("c", ("y", 2), ["q", "p", "q"])], "node_id string, f struct<s: string, n: int>, tags array<string>")
    view = patterns.subject_view(nodes, graph_of(spark, [("contains", "a", "b"), ("uses", "c", "c")]), fields)
    concepts = {
        "edge": {"edge_exists": {"direction": "in", "relation": "contains", "kind": "A"}}, "kind": {"fact_kind_present": {"kind": "B"}}, "null": {"field_equals": {"path": "f.s", "value": None}},
        "in": {"field_in": {"path": "f.n", "values": [2, 3]}}, "any": {"field_in": {"path": "tags", "values": ["q", "z"]}}, "set": {"field_set_equals": {"path": "tags", "values": ["q", "p"]}},
        "nested": {"and": [{"not": {"field_equals": {"path": "f.s", "value": "x"}}}, {"or": [{"edge_exists": {"direction": "out", "relation": "uses"}}, {"fact_kind_present": {"kind": "B"}}]}]},
    }
    rows = patterns.evaluated(view, "node_id", concepts, F.lit(True), True, frozenset({"tags"})).collect()
    held = {n: {r.node_id for r in rows if r.concept == n and r.outcome == "member"} for n in concepts}
    assert held == {"edge": {"b"}, "kind": {"a"}, "null": {"b"}, "in": {"c"}, "any": {"a", "c"}, "set": {"a", "c"}, "nested": {"c"}}


def test_a_pair_of_each_class(spark):
    base = dict(objects=["a", "b"], polarity="affirmed", modality="normative", scope="s", validity="v", term="Net Price", resolved=True)
    pairs = [
        ("equivalent_proposition", {}, {}), ("equivalent_proposition", {"objects": []}, {"objects": []}), ("equivalent_proposition", {}, {"term": "np"}), ("equivalent_proposition", {"resolved": False}, {"resolved": None}),
        ("direct_conflict", {}, {"polarity": "negated", "scope": "t"}), ("direct_conflict", {"objects": ["a"]}, {"polarity": "negated"}), ("equivalent_proposition", {}, {"polarity": "hedged"}),
        ("conformance_gap_candidate", {}, {"modality": "descriptive", "scope": "t"}), ("modality_divergence", {}, {"modality": "permissive", "scope": "t"}), ("modality_divergence", {"modality": "permissive"}, {"modality": "descriptive"}),
        ("scope_divergence", {}, {"scope": "t", "validity": "w"}), ("scope_divergence", {}, {"scope": None}), ("temporal_divergence", {}, {"validity": "w", "term": "np", "resolved": False}),
        ("terminology_conflict", {}, {"term": "np", "resolved": False}), ("terminology_conflict", {"objects": ["a"]}, {"term": "NetPrice!", "resolved": False}),
        ("referent_ambiguity", {}, {"term": "gross", "resolved": False}), ("referent_ambiguity", {"resolved": False}, {"objects": ["x"], "term": "np"}),
        ("compatible_partial", {}, {"objects": ["a", "c"]}), ("compatible_partial", {}, {"objects": ["a", "c"], "resolved": False}), ("compatible_partial", {}, {"objects": ["a", "c"], "scope": "t", "modality": "descriptive"}),
        ("incomparable", {}, {"objects": ["x"]}), ("incomparable", {"objects": ["a", "b", "c"]}, {"objects": ["a", "x", "y"], "polarity": "negated"}), ("incomparable", {}, {"objects": []}), ("incomparable", {}, {"objects": ["x"], "resolved": False}),
    ]
    names = ("objects", *comparison.FIELDS)
    rows = [(f"{k}{i}", i, *({**base, **change}[f] for f in names)) for k, (_, *sides) in enumerate(pairs) for i, change in enumerate(sides)]
    rows = [(bucket[:-1], *rest) for bucket, *rest in rows] + [("crowd", i, *(base[f] for f in names)) for i in range(41)]
    df = spark.createDataFrame(rows, "bucket string, id int, objects array<string>, polarity string, modality string, scope string, validity string, term string, resolved boolean")
    assert {r.bucket: r["class"] for r in comparison.compared(df, "bucket").collect()} == {str(k): want for k, (want, *_) in enumerate(pairs)}
    assert {want for want, *_ in pairs} == set(comparison.CLASSES)
    assert [(r.bucket, r.n, r.pairs) for r in comparison.oversize(df, "bucket").collect()] == [("crowd", 41, 820)]


def test_term_variants(spark):
    pairs = [
        ("NetPrice", "net_price", True), ("net", "NetPrice", True), ("ne", "net", False), ("a b", "ab", True), ("Order Line Item", "OLI", True), ("same", "same", False), ("x", "y", False),
        ("a.b", "A/B", True), ("O.L.I.", "Order/Line (Item)", True), ("o", "Order", False), ("--", "..", False), ("é", "e", False), (None, "x", False),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert [r for r in df.select("*", comparison.term_variant(F.col("a"), F.col("b")).alias("got")).collect() if r.want != r.got] == []


def test_verdicts(spark):
    df = spark.createDataFrame([(1, "supported"), (1, "refuted"), (2, "underdetermined"), (2, "supported"), (3, "supported"), (4, "unverifiable"), (4, "underdetermined")], "c int, r string")
    assert {r.c: r.verdict for r in comparison.verdict(df, "c", "r").collect()} == {1: "refuted", 2: "underdetermined", 3: "supported", 4: "unverifiable"}
    cells = spark.createDataFrame([(True, True), (True, None), (False, True), (None, None)], "s boolean, r boolean")
    assert [r[0] for r in cells.select(comparison.combined_signal(F.col("s"), F.col("r"))).collect()] == ["conflict", "supported", "refuted", "underdetermined"]


def test_bounded_walk_over_cycles_and_loops(spark):
    edges = graph_of(spark, [("r", "a", "b"), ("r", "b", "a"), ("r", "a", "a"), ("r", "a", "b"), ("r", "b", "c"), ("x", "a", "z")] + [("r", "c", f"d{i}") for i in range(5)] + [("r", f"d{i}", f"e{i}") for i in range(5)])
    rows = walks.bounded_walk(edges, spark.createDataFrame([("a",)], "node_id string"), ("r",), 5, frontier=3, directed=True).collect()
    visits = [("b", 1, 1, False), ("c", 2, 1, False), *((f"d{i}", 3, i + 1, True) for i in range(5)), *((f"e{i}", 4, i + 1, False) for i in range(3))]
    assert sorted((r.node, r.depth, r.position, r.cut) for r in rows) == sorted(visits)
    assert next(r.path for r in rows if r.node == "e2") == ["a", "b", "c", "d2", "e2"]


def walked(links, kinds, start, targets, depth, limit, frontier, neighbours):
    """The bounded justification walk, one queue at a time. links: (edge id, relation, src, dst)."""
    at: dict = {}
    for edge, relation, a, b in links:
        at.setdefault(a, []).append((edge, relation, b))
        if a != b:
            at.setdefault(b, []).append((edge, relation, a))
    before, found, front, cut = {start: None}, [], [start], False
    for _ in range(depth):
        following = []
        for node in front:
            for edge, _, other in sorted(at.get(node, []), key=lambda e: (len(at[e[2]]), e[1], e[2], e[0]))[:neighbours]:
                if other in before:
                    continue
                before[other] = (node, edge)
                if kinds[other] in targets:
                    found.append(other)
                if len(following) < frontier:
                    following.append(other)
                else:
                    cut = True
        front = following
    out = []
    for target in found[:limit]:
        path, edges = [target], []
        while before[path[0]]:
            node, edge = before[path[0]]
            path, edges = [node, *path], [edge, *edges]
        out.append((target, path, edges, len(found) > limit or cut))
    return out


@pytest.mark.parametrize("frontier, neighbours, limit", [(2, 3, 4), (32, 48, 12), (3, 2, 50)])
def test_provenance_against_one_queue(spark, frontier, neighbours, limit):
    rng = random.Random(frontier)
    pairs = [(rng.choice(["r", "q"]), f"n{rng.randrange(25):02}", f"n{rng.randrange(25):02}") for _ in range(45)]
    edges = graph_of(spark, pairs)
    links = [(r.edge_id, r.relation, r.src, r.dst) for r in edges.collect()]
    kinds = {f"n{i:02}": rng.choice("ABC") for i in range(25)}
    nodes = spark.createDataFrame(sorted(kinds.items()), "node_id string, kind string")
    rows = walks.provenance(nodes, edges, nodes.where("kind = 'C'"), ("r", "q"), ("A",), 4, limit, frontier, neighbours).collect()
    for start in (n for n, k in kinds.items() if k == "C"):
        got = [(r.target, r.path, r.edges, r.truncated) for r in sorted(rows, key=lambda r: r["rank"]) if r.source == start]
        assert got == walked(links, kinds, start, {"A"}, 4, limit, frontier, neighbours)


def test_provenance_keeps_no_visit_beyond_frontier_and_targets(spark):
    """Of 900 visits a level only those that are expanded and the first targets are rows, and the walk stays exact."""
    pairs = [("r", "a", f"b{i:02}") for i in range(30)] + [("r", f"b{i:02}", f"c{i:02}{j:02}") for i in range(30) for j in range(30)]
    edges = graph_of(spark, pairs)
    kinds = {n: n[0].upper() for _, a, b in pairs for n in (a, b)}
    hits = spark.createDataFrame([(n,) for n, k in kinds.items() if k == "C"], "node string")
    levels = walks._levels(walks._listed(edges, edges, hits, 48, False), spark.createDataFrame([("a",)], "node_id string"), 2, 5, 3)
    assert [level.count() for level in levels] == [5, 5]
    nodes = spark.createDataFrame(sorted(kinds.items()), "node_id string, kind string")
    rows = sorted(walks.provenance(nodes, edges, nodes.where("kind = 'A'"), ("r",), ("C",), 2, 2, 5, 48).collect(), key=lambda r: r["rank"])
    links = [(r.edge_id, r.relation, r.src, r.dst) for r in edges.collect()]
    assert [(r.target, r.path, r.edges, r.truncated) for r in rows] == walked(links, kinds, "a", {"C"}, 2, 2, 5, 48)


def test_recipes(spark):
    edges, kinds = graph_of(spark, [("r", "a", "b"), ("r", "b", "c"), ("r", "c", "d")]), spark.createDataFrame([("a", "K"), ("b", "S"), ("c", "K"), ("d", "K")], "node_id string, kind string")
    run = lambda start, *a: {(r.node, r.depth) for r in walks.recipe(edges, kinds, spark.createDataFrame([(start,)], "node_id string"), *a).collect()}
    assert run("a", 3, "downstream", ("r",)) == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert run("a", 3, "downstream", ("r",), ("S",)) == {("a", 0), ("b", 1)}
    assert run("d", 1, "upstream", ("r",)) == {("d", 0), ("c", 1)} and run("a", 0, "both", ("r",)) == {("a", 0)}
    with pytest.raises(ValueError):
        run("a", 4, "both", ("r",))


def test_betweenness_by_hand(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdx"], "node_id string")
    links = [("r", "a", "b"), ("r", "b", "c"), ("r", "b", "d"), ("r", "d", "gone")]
    assert {r.node: r.score for r in walks.sampled_betweenness(nodes, graph_of(spark, links)).collect()} == {"a": 0, "b": 2, "c": 0, "d": 0, "x": 0}
    chain = spark.createDataFrame([(f"n{i:02}",) for i in range(20)], "node_id string")
    found = walks.sampled_betweenness(chain, graph_of(spark, [("r", f"n{i:02}", f"n{i + 1:02}") for i in range(19)])).collect()
    assert {r.node: r.score for r in found} == {f"n{i:02}": i * (19 - i) for i in range(20)}


def test_betweenness_against_brute_force(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(20):02}", f"n{rng.randrange(20):02}") for _ in range(60)]
    pairs += pairs[:15]
    ids = sorted(f"n{i:02}" for i in range(22))
    links: dict = {n: [] for n in ids}
    for a, b in pairs:
        links[a].append(b)
    score, starts = dict.fromkeys(ids, 0.0), ids[:6]
    for s in starts:
        depth, paths, before, order, queue = {s: 0}, {s: 1}, {n: [] for n in ids}, [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in links[v]:
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        passed = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                passed[v] += paths[v] / paths[w] * (1 + passed[w])
            if w != s:
                score[w] += passed[w]
    edges = graph_of(spark, [("r", a, b) for a, b in pairs])
    found = {r.node: r.score for r in walks.sampled_betweenness(spark.createDataFrame([(n,) for n in ids], "node_id string"), edges, 6).collect()}
    assert found == {n: pytest.approx(x * len(ids) / 6, abs=1e-5) for n, x in score.items()}


def test_leaves_of_any_depth(spark):
    deep = '{"a": [' * 50 + '"end"' + "]}" * 50
    found = records.leaves(spark.createDataFrame([(1, deep)], "id int, j string"), "id", "j").collect()
    assert [(r.path.count("a[]"), r.value) for r in found] == [(50, "end")]


def test_withholding_is_linear_and_keeps_references(spark):
    import time

    cases = {
        'a.password: "x y"': "a.password: '[redacted]'", "token=`abc`;": "token='[redacted]';", "secret: \"a'": "secret: '[redacted]'", "API-KEY = process.env.KEY, api_key: ''": "API-KEY = process.env.KEY, api_key: '[redacted]'",
        "token = secret='v'": "token = secret='v'", "token = x, secret='v'": "token = x, secret='[redacted]'", 'password "x"': 'password "x"', 'token: "a\nb"': 'token: "a\nb"', '"token": \'v\'}': '"token": \'[redacted]\'}',
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [(r.t, r.got) for r in df.select("*", text.withheld(F.col("t")).alias("got")).collect() if r.want != r.got] == []
    long = spark.createDataFrame([("a" * 1_000_000,), ("token" * 200_000,), ("token='" * 100_000,), ("token" + " " * 1_000_000,)], "t string")
    start = time.perf_counter()
    long.select(F.length(text.withheld(F.col("t")))).collect()
    assert time.perf_counter() - start < 10


def test_leaves_and_addresses(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, "x", null]}, "c": true}'), (2, "[[1], []]"), (3, "not json"), (4, None), (5, "7")], "id int, j string")
    found = records.addressed(records.leaves(df, "id", "j"), "id").collect()
    assert sorted((r.id, r.path, r.value, r.multiplicity) for r in found if r.value is not None) == [(1, "a.b[]", "1", 3), (1, "a.b[]", "x", 3), (1, "c", "true", 1), (2, "[][]", "1", 1), (5, "", "7", 1)]


def test_identity_and_storage_ids(spark):
    row = spark.range(1).select(records.identity(F.lit("a"), F.lit("bc")).alias("x"), records.identity(F.lit("ab"), F.lit("c")).alias("y"), records.identity(F.lit(""), F.lit(None)).alias("z"), records.identity(F.lit(None), F.lit("")).alias("w")).first()
    assert len(set(row)) == 4
    df = spark.createDataFrame([("i", "p"), ("i", "p"), ("i", "q"), ("j", "p")], "i string, c string")
    ids = sorted(r.storage_id for r in records.storage_ids(df, F.col("i"), F.col("c")).collect())
    assert len(set(ids)) == 4 and ids[-1] == "j" and sum(x.endswith("#2") for x in ids) == 1


def test_constrained_union_against_brute_force(spark):
    """Components with and without forbidden pairs, against ordered merges over all pairs at once."""
    from lodegraph.operators import claims

    rng = random.Random(9)
    pairs = sorted({tuple(sorted((rng.randrange(60), rng.randrange(60)))) for _ in range(45)} - {(i, i) for i in range(60)})
    apart = [(rng.randrange(60), rng.randrange(60)) for _ in range(25)]
    group = {i: {i} for p in pairs for i in p}
    for a, b in pairs:
        if group[a] is not group[b] and not any((x in group[a] and y in group[b]) or (y in group[a] and x in group[b]) for x, y in apart):
            merged = group[a] | group[b]
            for i in merged:
                group[i] = merged
    df = lambda rows: spark.createDataFrame(rows, "left long, right long")
    found = {r.id: r.group for r in claims.constrained_union(df(pairs), df(apart)).collect()}
    assert found == {i: min(g) for i, g in group.items()}
