"""Operators on literal fixtures."""

from __future__ import annotations

import random

import pytest

from lodegraph.functions import text
from lodegraph.operators import claims, delta, documents, evaluation, graph, joins, resolution, sets
from lodegraph.operators.components import connected_components
from pyspark.sql import functions as F


def test_components_of_chains_cycles_and_stars(spark):
    pairs = [(f"a{i}", f"a{i + 1}") for i in range(40)] + [("x", "y"), ("y", "z"), ("z", "x"), ("s", "s"), ("x", "y")] + [("hub", f"leaf{i}") for i in range(50)] + [(None, "q")]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert {found[f"a{i}"] for i in range(41)} == {"a0"}
    assert found["x"] == found["y"] == found["z"] == "x"
    assert {found[f"leaf{i}"] for i in range(50)} == {found["hub"]} == {"hub"}
    assert "s" not in found and "q" not in found


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


EDGES = "edge_id string, relation string, role string, parent_end string, src string, dst string"


def test_self_loops_cycles_and_parallel_edges(spark):
    edges = spark.createDataFrame([("1", "contains", "structural", "from", "a", "b"), ("2", "contains", "structural", "from", "b", "a"), ("3", "contains", "structural", "from", "a", "a"), ("4", "contains", "structural", "from", "a", "b")], EDGES)
    assert graph.both_ways(edges).where("edge_id = '3'").count() == 1
    assert {(r.node_id, r.descendants) for r in graph.descendants(edges).collect()} == {("a", 1), ("b", 1)}


def test_resolution_statuses(spark):
    refs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, key string")
    targets = spark.createDataFrame([("t1", "a"), ("t2", "b"), ("t3", "b"), ("t3", "b"), ("t4", None)], "t string, k string")
    found = {r.id: (r.status, r.target, r.n_candidates, r.candidates) for r in joins.resolve(refs, targets, "id", "key", "t", "k").collect()}
    assert found == {1: ("resolved", "t1", 1, None), 2: ("ambiguous", None, 2, ["t2", "t3"]), 3: ("unresolved", None, 0, None), 4: ("unresolved", None, 0, None)}


def test_overlaps_are_found_once(spark):
    left = spark.createDataFrame([("k", 0, 300), ("k", 5, 6)], "k string, a0 int, a1 int")
    right = spark.createDataFrame([("k", 100, 250), ("k", 6, 6), ("k", 400, 500), ("j", 0, 999)], "k string, b0 int, b1 int")
    found = sorted((r.a0, r.b0) for r in joins.overlapping(left, right, ["k"], ("a0", "a1"), ("b0", "b1"), 16).collect())
    assert found == [(0, 6), (0, 100), (5, 6)]


def test_inventory_states_and_renames(spark):
    old = spark.createDataFrame([("same", "1"), ("mod", "2"), ("gone", "3"), ("twin1", "4"), ("twin2", "4")], "path string, digest string")
    new = spark.createDataFrame([("same", "1"), ("mod", "9"), ("came", "3"), ("twin3", "4")], "path string, digest string")
    found = {r.path: (r.state, r.renamed_from) for r in sets.inventory_diff(old, new).collect()}
    assert found["came"] == ("added", "gone") and found["twin3"] == ("added", None)
    assert found["same"][0] == "unchanged" and found["mod"][0] == "modified" and found["gone"][0] == "deleted"


def test_union_refuses_another_digest(spark):
    one = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, digest string")
    assert sets.checked_union(one, one).count() == 2
    with pytest.raises(Exception, match="digest collision for a"):
        sets.checked_union(one, spark.createDataFrame([("a", "9")], "id string, digest string")).collect()


def test_constrained_union_keeps_walls(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("p", "q")], "left string, right string")
    found = {r.id: r.group for r in claims.constrained_union(pairs, spark.createDataFrame([("a", "c")], "left string, right string")).collect()}
    assert found == {"a": "a", "b": "a", "c": "c", "d": "c", "p": "p", "q": "p"}


def test_pair_classes(spark):
    rows = [("k", 1, True, "m", ["x", "y"]), ("k", 2, True, "m", ["y", "x"]), ("k", 3, False, "m", ["x", "y"]), ("k", 4, True, "n", ["x"]), ("k", 5, True, "m", ["z"])]
    found = {(r.left_id, r.right_id): r["class"] for r in claims.pair_classes(spark.createDataFrame(rows, "k string, id int, polarity boolean, modality string, objects array<string>"), ["k"]).collect()}
    assert found[(1, 2)] == "equivalent" and found[(1, 3)] == "direct_conflict" and found[(1, 4)] == "modality_divergence" and found[(1, 5)] == "incomparable"
    assert claims.pair_classes(spark.createDataFrame(rows, "k string, id int, polarity boolean, modality string, objects array<string>"), ["k"], cap=3).count() == 0


@pytest.mark.parametrize("n_nodes, n_edges", [(12, 30), (40, 30), (30, 29), (60, 45)])
def test_within_two_equals_reach(spark, n_nodes, n_edges):
    rng = random.Random(n_nodes)
    pairs = [(rng.randrange(n_nodes), rng.randrange(n_nodes)) for _ in range(n_edges)] + [(0, 0), (None, 1)]
    edges = spark.createDataFrame([(None if a is None else f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    starts = spark.createDataFrame([(f"n{i}",) for i in range(0, n_nodes, 2)] + [("away",)], "node_id string")
    expected = graph.reach(edges, starts, 2, directed=False).where("depth > 0").groupBy("source").count().collect()
    assert sorted(map(tuple, graph.within_two(edges, starts).collect())) == sorted(map(tuple, expected))


def test_within_two_lists_no_leaf(spark):
    leaves = spark.range(400_000).select(F.lit("hub").alias("src"), F.concat(F.lit("l"), "id").alias("dst"))
    starts = leaves.select(F.col("dst").alias("node_id"))
    found = graph.within_two(leaves, starts)  # 160 billion pairs
    assert found.agg(F.count("*"), F.min("n"), F.max("n")).head() == (400_000, 400_000, 400_000)


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_two_step_counts(spark, most):
    rng = random.Random(most)
    first = [(rng.randrange(9), rng.randrange(12)) for _ in range(40)] + [(1, None), (None, 1)]
    second = [(rng.randrange(12), rng.randrange(30)) for _ in range(60)] + [(None, 1)]
    got = graph.two_step_counts(spark.createDataFrame(first, "source long, via long"), spark.createDataFrame(second, "via long, node long"), most).collect()
    met: dict = {}
    for s, v in first:
        for w, n in second:
            if s is not None and v is not None and v == w:
                met.setdefault(s, set()).add(n)
    assert {r.source: r.n for r in got} == {s: len(v) for s, v in met.items()}


def test_names_in_scopes_against_brute_force(spark):
    rng = random.Random(6)
    refs = [(i, rng.choice([None, "p", "q", "r"]), [rng.choice([None, 0, 1, 2, 3]) for _ in range(rng.randrange(4))]) for i in range(60)] + [(99, "p", None)]
    targets = [(rng.choice([None, *range(8)]), rng.choice([None, "p", "q"]), rng.choice([None, 0, 1, 2])) for _ in range(25)]
    made = spark.createDataFrame(targets, "t long, key string, scope long")
    got = resolution.in_scope(spark.createDataFrame(refs, "id long, key string, scopes array<long>"), made, "id", "key", "scopes", "t", "key", "scope").collect()
    assert len(got) == len(refs)
    for i, key, scopes in refs:
        found = {t for t, k, s in targets if None not in (t, k, s) and k == key and s in (scopes or [])}
        row = next(r for r in got if r.id == i)
        assert (row.n_candidates, row.target) == (len(found), min(found) if len(found) == 1 else None)


def test_names_in_scopes_list_no_pairs(spark):
    refs = spark.range(300_000).select("id", F.lit("p").alias("key"), F.array(F.lit(0), F.lit(1)).alias("scopes"))
    targets = spark.range(300_000).select(F.col("id").alias("t"), F.lit("p").alias("key"), (F.col("id") % 2).cast("int").alias("scope"))
    found = resolution.in_scope(refs, targets, "id", "key", "scopes", "t", "key", "scope")  # 90 billion pairs
    assert found.agg(F.count("*"), F.min("n_candidates")).head() == (300_000, 300_000)


def test_negations_end_at_ascii_words(spark):
    texts = {"Noñasción": True, "éno": True, "is NOT so": True, "no": True, "notes": False, "_no": False, "no1": False, "": False}
    rows = spark.createDataFrame(list(texts.items()), "text string, expected boolean").withColumn("found", text.negative(F.col("text"))).collect()
    assert {r.text: r.found for r in rows} == texts


def test_byte_windows_partition_lines(spark):
    value = "aaaa\nbb\n" + "c" * 30 + "\nd\n\né"
    rows = documents.byte_windows(spark.createDataFrame([(1, value), (2, None)], "doc_id long, text string"), most=10, overlap=3).where("doc_id = 1").orderBy("window").collect()
    assert [(r.line, r.line_end) for r in rows] == [(1, 2), (3, 3), (4, 6)]
    assert [r.context_line for r in rows] == [1, 2, 3]
    assert sum(r.n_bytes for r in rows) == len(value.encode()) + 1


def test_sections_ignore_fences(spark):
    lines = documents.numbered_lines(spark.createDataFrame([(1, "# a\ntext\n## b\n```\n# no\n```\n# c\nend")], "doc_id long, text string"))
    level = F.when(F.col("content").rlike("^#+ "), F.length(F.regexp_extract("content", "^(#+)", 1)))
    assert sorted((r.line, r.level, r.line_end) for r in documents.sections(lines, level, 6).collect()) == [(1, 1, 6), (3, 2, 6), (7, 1, 8)]


def test_unit_plan_and_drift(spark):
    units = spark.createDataFrame([(1, "a", "v"), (2, "b", "v"), (3, "c", "v"), (4, "d", "v")], "id int, digest string, contract string")
    cache = spark.createDataFrame([(1, "a", "v"), (2, "x", "v"), (3, "c", "old")], "id int, digest string, contract string")
    assert {r.id: r.reason for r in delta.unit_plan(units, cache).collect()} == {1: "hit", 2: "content_changed", 3: "contract_changed", 4: "new"}


def test_text_functions(spark):
    row = spark.range(1).select(
        text.slug(F.lit(" My-App  Name! ")).alias("slug"),
        text.surface_fold(F.lit("camelCase_name-x")).alias("fold"),
        text.url_path(F.lit("https://h.example/a/b/?q#f")).alias("path"),
        text.withheld(F.lit("password = \"abc\" token: x api_key:'k'")).alias("held"),
        text.json_or_marker(F.lit("{bad")).alias("bad"),
        text.wilson(F.lit(0), F.lit(0)).alias("none"),
    ).first()
    assert row.slug == "my-app-name" and row.fold == "camelcasenamex" and row.path == "/a/b"
    assert row.held == "password = '[redacted]' token: x api_key:'[redacted]'"
    assert row.bad == '{"unparsed":true,"raw":"{bad"}' and row.none is None


def test_bootstrap_covers_the_mean(spark):
    units = spark.range(400).select(F.col("id").alias("u"), (F.col("id") % 10).cast("double").alias("v"))
    row = evaluation.bootstrap_interval(units, "u", "v", 200).first()
    assert row.n == 400 and row.low < row["mean"] < row.high and row.high - row.low < 1.2


@pytest.mark.parametrize("seed, extra", [(0, 0), (1, 0), (2, 3), (3, 12), (4, 40)])
def test_descendants_of_trees_meshes_and_cycles(spark, seed, extra):
    """A tree, with more parents for some nodes, and edges back up."""
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(max(0, i - 6), i)}", f"n{i}") for i in range(1, 40)} | {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(extra)} | {("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("c1", "leaf"), ("self", "self")} | {(f"d{i}", f"d{i + 1}") for i in range(20)}
    rows = [(str(k), "contains", "structural", "from", a, b) for k, (a, b) in enumerate(sorted(pairs))]
    below: dict = {}
    for a, b in pairs:
        below.setdefault(a, set()).add(b)

    def reached(node):
        seen, work = set(), [node]
        while work:
            for child in below.get(work.pop(), ()):
                if child not in seen:
                    seen.add(child)
                    work.append(child)
        return len(seen - {node})

    found = {r.node_id: r.descendants for r in graph.descendants(spark.createDataFrame(rows, "edge_id string, relation string, role string, parent_end string, src string, dst string")).collect()}
    assert found == {a: reached(a) for a in below if reached(a)}
