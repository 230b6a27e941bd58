"""Tables are dealt to tasks of bounded size, and what is dealt gives the same rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from lodegraph import runtime
from lodegraph.operators import graph, memberships, walks
from lodegraph.queries import code
from lodegraph.sources import star

EDGES = "edge_id string, relation string, role string, parent_end string, src string, dst string"


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(runtime, "TASK_ROWS", 1500)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_take_as_many_tasks_as_their_rows_need(spark, sf_dir, small_tasks):
    lines = star.table(spark, sf_dir, "lineitem").count()
    assert star.tasks(spark, sf_dir) == -(-lines // 1500) > 1
    assert star.edges(spark, sf_dir, ("depends_on",)).rdd.getNumPartitions() >= star.tasks(spark, sf_dir)


@pytest.mark.parametrize("name", ["neighbors_in", "neighbors_out", "neighbors_both", "node_bundles", "node_neighbors_ranked", "domain_propagation", "view_shapes", "concept_lists", "obligation_states", "witnessed_memberships"])
def test_small_tasks_give_the_same_rows(spark, sf_dir, monkeypatch, name):
    rows = lambda: sorted(map(str, entry.queries()[name](spark, sf_dir).collect()))
    whole = rows()
    monkeypatch.setattr(runtime, "TASK_ROWS", 1500)
    assert rows() == whole


def test_one_way_makes_no_row_of_the_other_direction(spark, sf_dir):
    for name in ("neighbors_in", "neighbors_out"):
        assert "Generate" not in plan(entry.queries()[name](spark, sf_dir))


ODD = [("e1", "r", "flow", None, "a", "a"), ("e2", "r", "flow", None, "a", "b"), ("r|a|b", "r", "flow", None, "a", "b"), ("e3", "r", "structural", "from", "a", "gone"), ("e4", "r", "flow", None, None, "b"), (None, "r", "flow", None, "b", "c")]


def test_counts_by_pair_and_bundles_of_loops_parallels_and_missing_ends(spark):
    edges = spark.createDataFrame(ODD, EDGES)
    assert {(r.node, r.n, r.n_distinct) for r in graph.neighbour_counts(edges, 3).collect()} == {("a", 4, 3), ("b", 4, 2), ("gone", 1, 1), (None, 1, 1), ("c", 1, 1)}
    nodes = spark.createDataFrame([("a", "A", "x"), ("b", "B", "y"), ("b", "B", "y"), ("c", None, "z")], "node_id string, kind string, label string")
    found = {(r.node, r.direction, r.other_kind, r.n) for r in graph.bundles(nodes, edges, 3).collect()}
    assert found == {("a", "out", "A", 1), ("a", "out", "B", 4), ("b", "in", "A", 2), (None, "out", "B", 2), ("b", "out", None, 1), ("gone", "in", "A", 1), ("c", "in", "B", 2)}


def test_ranking_moves_only_ids_that_arent_spelled(spark):
    edges = spark.createDataFrame(ODD, EDGES)
    nodes = spark.createDataFrame([("a", "A", "x"), ("b", "B", "y"), ("c", None, "z")], "node_id string, kind string, label string")
    found = {(r.node, r["rank"], r.direction, r.other, r.truncated) for r in graph.ranked_neighbours(nodes, edges, 2, 3).collect()}
    assert {r for r in found if r[0] in ("a", "b")} == {("a", 1, "out", "a", True), ("a", 2, "out", "b", True), ("b", 1, "out", "c", True), ("b", 2, "in", "a", True)}
    assert ("gone", 1, "in", "a", False) in found
    assert "_own" in plan(graph.ranked_neighbours(nodes, edges, 2, 3))


def test_votes_are_made_distinct_not_pairs(spark):
    edges = spark.createDataFrame([("a", "x"), ("a", "x"), ("y", "a"), ("b", "b")], "src string, dst string")
    anchors = spark.createDataFrame([("x", "d"), ("y", "d"), ("b", "e")], "node_id string, domain string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    found = {(r.node_id, r.domain, r.state, r.n_domains) for r in walks.propagated(edges, anchors, nodes, 3).collect()}
    assert found == {("a", "d", "assigned", 1), ("b", "e", "assigned", 1), ("c", None, "no_anchor", 0)}


def test_customers_shapes_and_lists_pair_no_order_with_its_parts_twice(spark, sf_dir):
    for name in ("view_shapes", "concept_lists"):
        assert "Expand" not in plan(entry.queries()[name](spark, sf_dir)) and "partial_count(distinct" not in plan(entry.queries()[name](spark, sf_dir))


def test_witnesses_move_only_edges_that_a_leaf_can_match(spark):
    nodes = spark.createDataFrame([("a", "M"), ("x", "Api")], "node_id string, kind string")
    edges = spark.createDataFrame([("e1", "calls", "flow", None, "a", "x", "test"), ("e2", "owns", "flow", None, "a", "x", "docs")], f"{EDGES}, provenance_class string")
    concept = {"expression": {"edge_exists": {"direction": "out", "relation": "calls", "kind": "Api"}}}
    found = memberships.edge_witnesses(nodes, edges, {"role": concept}, 3)
    assert plan(found).count("Join ") == 1
    assert [(r.node_id, r.direction, r.edge_id, r.provenance_class, r.nth) for r in found.collect()] == [("a", "out", "e1", "test", 1)]


def test_obligations_carry_only_what_their_kind_asks_for(spark, sf_dir):
    made = code._obligations(spark, sf_dir)[0]
    assert made.where("kind <> 'tree_text_absent' AND needles IS NOT NULL").isEmpty()
    assert made.where("kind NOT IN ('tree_paths_exact', 'tree_paths_present', 'tree_text_absent') AND paths IS NOT NULL").isEmpty()


def test_slices_read_their_edges_once(spark, sf_dir, monkeypatch):
    read = []
    grown = code.slices.enumerated
    monkeypatch.setattr(code.slices, "enumerated", lambda seeds, groups, edges: read.append(edges.inputFiles()) or grown(seeds, groups, edges))
    entry.queries()["graph_slices"](spark, sf_dir)
    assert read and not any("lineitem" in f for f in read[0])


def test_scopes_are_bound_in_as_many_tasks_as_asked(spark):
    points = spark.createDataFrame([("a", 5, "p"), ("b", 50, "q")], "k string, at long, name string")
    spans = spark.createDataFrame([("a", 0, 10, "s"), ("a", 4, 6, "t"), ("b", 0, 10, "u")], "k string, start long, end long, scope string")
    found = code.callsites.innermost(points, spans, ["k"], "at", "start", "end", "scope", 7)
    assert found.rdd.getNumPartitions() == 7 and {(r.name, r.scope) for r in found.collect()} == {("p", "t"), ("q", None)}
