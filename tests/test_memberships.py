"""Memberships, witnesses and the questions asked of them, on literal fixtures."""

from __future__ import annotations

import pytest

from lodegraph.operators import memberships

EDGES = "edge_id string, relation string, role string, parent_end string, src string, dst string, provenance_class string"
ROLE = {"expression": {"edge_exists": {"direction": "out", "relation": "calls", "kind": "Api"}}, "closed_world": True, "role": True}
FIELD = {"expression": {"or": [{"field_equals": {"path": "lang", "value": "js"}}, {"not": {"edge_exists": {"direction": "in", "relation": "owns"}}}]}, "closed_world": False}
OPEN = {"expression": {"fact_kind_present": {"kind": "Fact"}}, "closed_world": False}


@pytest.fixture(scope="module")
def frames(spark):
    nodes = spark.createDataFrame([(n, "Module") for n in "abcde"] + [("x", "Api"), ("y", "Api"), ("f", "Fact"), ("o", "Owner")], "node_id string, kind string")
    edges = [("e1", "calls", "a", "x", "production"), ("e2", "calls", "a", "y", "test"), ("e3", "calls", "b", "x", "test"), ("e4", "calls", "b", "y", "docs"), ("e5", "calls", "c", "f", "production"), ("e6", "owns", "o", "a", "fixture"), ("e7", "owns", "o", "d", "production"), ("e8", "contains", "c", "f", "production"), ("e9", "calls", "e", "e", "production")]
    edges = spark.createDataFrame([(i, r, "flow", None, a, b, p) for i, r, a, b, p in edges], EDGES)
    subjects = spark.createDataFrame([("a", 1, "js"), ("b", 2, "py"), ("c", 3, None), ("d", 4, "py"), ("e", 5, "js")], "node_id string, claim_id long, lang string")
    return subjects, nodes, edges


def outcomes(rows, concept):
    return {r.node_id: (r.outcome, r.result, r.reason, r.confidence, r.n_witnesses) for r in rows if r.concept == concept}


def test_outcomes_and_witnesses(frames):
    made, witnesses = memberships.evaluated(*frames, {"role": ROLE, "field": FIELD, "open": OPEN})
    rows, seen = made.collect(), witnesses.collect()
    assert outcomes(rows, "role") == {
        "a": ("member", "matched", None, "certain", 2), "b": ("not_member", "matched_scope_excluded", "TEST_OR_FIXTURE_ONLY", "certain", 2), "c": ("not_member", "not_matched_closed_world", None, "likely", 1),
        "d": ("not_member", "not_matched_closed_world", None, "likely", 1), "e": ("not_member", "not_matched_closed_world", None, "likely", 1),
    }
    assert outcomes(rows, "field") == {
        "a": ("member", "matched", None, "certain", 1), "b": ("member", "matched", None, "likely", 1), "c": ("member", "matched", None, "likely", 1), "d": ("abstain", "insufficient_evidence", "INVENTORY_INCOMPLETE", None, 0), "e": ("member", "matched", None, "likely", 1),
    }
    assert {n for n, o in outcomes(rows, "open").items() if o[0] == "member"} == {"c"}
    summary = {r.node_id: (r.n_production, r.n_test, r.n_fixture, r.n_docs) for r in rows if r.concept == "role"}
    assert (summary["a"], summary["b"], summary["c"]) == ((1, 1, 0, 0), (0, 1, 0, 1), (0, 0, 0, 0))
    assert {(r.node_id, r.witness, r.other, r.other_kind) for r in seen if r.concept == "role" and r.kind == "projected_edge"} == {("a", "e1", "x", "Api"), ("a", "e2", "y", "Api"), ("b", "e3", "x", "Api"), ("b", "e4", "y", "Api")}
    assert {(r.node_id, r.witness) for r in seen if r.concept == "field"} == {("a", "e6"), ("b", "2"), ("c", "3"), ("e", "5")}
    assert {(r.node_id, r.witness) for r in seen if r.concept == "open"} == {("c", "e8")}


def test_an_outcome_needs_a_witness(spark, frames):
    subjects, nodes, edges = frames
    bare = spark.createDataFrame([("c", None, None)], "node_id string, claim_id long, lang string")
    with pytest.raises(memberships.MissingWitness, match="c"):
        memberships.evaluated(bare, nodes, edges, {"role": ROLE})
    made, witnesses = memberships.evaluated(bare, nodes, edges, {"open": OPEN})
    assert made.count() == witnesses.count() == 1
    made, witnesses = memberships.evaluated(subjects.limit(0), nodes, edges, {"role": ROLE})
    assert made.count() == witnesses.count() == 0


def test_questions(spark, frames):
    made, witnesses = memberships.evaluated(*frames, {"role": ROLE, "field": FIELD})
    judged = memberships.contested(made, spark.createDataFrame([("b", "field"), ("d", "field"), ("a", "role")], "node_id string, concept string"))
    ids = lambda df: [(r.node_id, r.truncated) for r in df.collect()]
    assert ids(memberships.members(judged, "field")) == [("a", False), ("b", False), ("c", False), ("e", False)]
    assert ids(memberships.members(judged, "field", limit=3)) == [("a", True), ("b", True), ("c", True)]
    assert ids(memberships.members(judged, "field", "certain")) == [("a", False)] and ids(memberships.members(judged, "field", "likely", 2)) == [("a", True)]
    assert ids(memberships.members(judged, "field", "contested", 2)) == [("a", True), ("b", True)]
    assert ids(memberships.conflicts(judged, "field")) == [("b", False)] and ids(memberships.conflicts(judged, "role")) == [("a", False)]
    assert [(r.concept, r.outcome) for r in memberships.concepts_of(judged, "d").collect()] == [("field", "abstain"), ("role", "not_member")]
    assert {(r.outcome, r.witness) for r in memberships.why(judged, witnesses, "role", "b").collect()} == {("not_member", "e3"), ("not_member", "e4")}
    assert [(r.outcome, r.witness) for r in memberships.why(judged, witnesses, "field", "d").collect()] == [("abstain", None)]
    with pytest.raises(LookupError):
        memberships.why(judged, witnesses, "role", "nobody")
    with pytest.raises(ValueError):
        memberships.members(judged, "field", "sure")
    with pytest.raises(ValueError):
        memberships.members(judged, "field", limit=2001)


def test_drift_and_its_cause(frames):
    subjects, nodes, edges = frames
    before, _ = memberships.evaluated(*frames, {"field": FIELD})
    after, _ = memberships.evaluated(subjects.where("node_id <> 'e'"), nodes, edges.where("edge_id <> 'e7'"), {"field": FIELD})
    head = {"definition": "1", "policy": "1", "source": "1"}
    rows = memberships.drift(before, after, "field", head, head).collect()
    assert {(r.node_id, r.outcome_a, r.outcome_b, r.cause) for r in rows if r.changed} == {("d", "abstain", "member", "evidence"), ("e", "member", None, "evidence")}
    for change, cause in (({"source": "2"}, "source"), ({"source": "2", "policy": "2"}, "policy"), ({"definition": "2", "policy": "2"}, "definition")):
        assert {r.cause for r in memberships.drift(before, after, "field", head, {**head, **change}).collect()} == {cause}
