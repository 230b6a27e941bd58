"""Mentions and claims on literal fixtures."""

from __future__ import annotations

import datetime

import pytest
from lodegraph.operators import mentions
from pyspark.sql import functions as F


def rows(df):
    return [tuple(r) for r in df.orderBy(*df.columns).collect()]


def test_surfaces_by_kind(spark):
    docs = spark.createDataFrame([(1, "Owner: the API uses `load_all` and **Hot Key**.\nowner_id: API"), (2, ""), (3, None)], "doc_id int, text string")
    assert rows(mentions.surfaces(docs)) == [
        (1, "acronym", "API", 2), (1, "code", "load_all", 1), (1, "field", "Owner", 1), (1, "field", "owner_id", 1), (1, "symbol", "load_all", 1), (1, "symbol", "owner_id", 1), (1, "term", "Hot Key", 1),
    ]


def test_signals_list_eight_witnesses_and_count_all(spark):
    signals = spark.createDataFrame([("Order", "type", i) for i in range(20)] + [("order", "api", 1), ("--", "api", 2), (None, "api", 3)], "name string, kind string, w int")
    found = mentions.clustered_signals(signals, F.regexp_replace(F.lower("name"), "[^a-z]", ""), "kind", "w").orderBy("kind").collect()
    assert [(r.entity, r.kind, r.n, len(r.examples), r.n_kinds) for r in found] == [("order", "api", 1, 1, 2), ("order", "type", 20, 8, 2)]


def test_lines_of_an_answer(spark):
    lines = spark.createDataFrame([("a", 1, "ev", 1), ("a", 2, "rel", 1), ("a", 3, "ev", 1), ("a", 4, "rel", 1), ("a", 5, "what", 1), ("a", 6, "rel", None), ("b", 1, "ev", 1)], "a string, at int, k string, i int")
    found = mentions.relation_lines(lines, "a", "at", "k", "i").orderBy("a", "at").collect()
    assert [r.disposition for r in found] == ["orphan", "relation", "evidence", "duplicate", "unknown", "unindexed", "orphan"]


def test_propositions_fold_what_does_not_matter(spark):
    day = datetime.date(2024, 1, 1)
    claims = [(" Svc ", "MUST", "x", None, None, "Emit b, a; A"), ("svc", "must", "x", None, None, "a b emit"), ("", "odd", None, day, None, None), (None, None, None, None, day, "")]
    df = spark.createDataFrame(claims, "s string, m string, c string, f date, u date, t string")
    found = [tuple(r.p) for r in df.select(mentions.proposition(F.col("s"), F.col("m"), F.col("c"), F.col("f"), F.col("u"), F.col("t")).alias("p")).collect()]
    assert found[0] == found[1] == ("svc", "binding", "x", "unbounded", "a b emit")
    assert found[2] == found[3] == ("unassigned", "stated", "any", "bounded", "")


def test_standing_of_subjects(spark):
    support = spark.createDataFrame([("code", "code"), ("told", "comment"), ("told", "document"), ("mixed", "code"), ("mixed", "comment"), ("else", "other")], "k string, kind string")
    subjects = spark.createDataFrame([(k,) for k in ("code", "told", "mixed", "else", "none", "none")], "k string")
    assert rows(mentions.standings(subjects, support, "k", "kind")) == [
        ("code", "proposed", "observed code", 1), ("else", "proposed", None, 1), ("mixed", "proposed", None, 2), ("none", "held", None, 0), ("told", "proposed", "claim", 2),
    ]


def test_the_first_rule_excludes(spark):
    rules = [{"component": "app", "prefix": "gen/", "reason": "generated"}, {"component": "app", "name": "x.js", "reason": "named"}]
    df = spark.createDataFrame([("app", "gen/x.js"), ("app", "src/x.js"), ("lib", "gen/x.js"), ("app", None)], "c string, p string")
    assert [r.r for r in df.select(mentions.exclusion_reason(F.col("c"), F.col("p"), rules).alias("r")).collect()] == ["generated", "named", None, None]
    with pytest.raises(ValueError, match="a rule takes one"):
        mentions.exclusion_reason(F.col("c"), F.col("p"), [{"component": "app", "reason": "none"}])


def test_ignore_lines(spark):
    lines = ["  ./build/ ", "# note", "", "/abs", "../up", "a/../b", "C:\\x", "a..b/c", None]
    assert [r.r for r in spark.createDataFrame([(x,) for x in lines], "c string").select(mentions.ignore_rule(F.col("c")).alias("r")).collect()] == ["build", None, None, None, None, None, None, "a..b/c", None]


def test_subject_takes_edges_and_neighbours(spark):
    nodes = spark.createDataFrame([("x",), ("y",), ("z",), ("far",)], "node_id string")
    edges = spark.createDataFrame([("e1", "x", "y"), ("e2", "z", "x"), ("e3", "z", "far"), ("e4", "x", "x")], "edge_id string, src string, dst string")
    aliases = spark.createDataFrame([("The X", "x"), ("the x", "x"), ("the x", "gone"), ("other", "far")], "alias string, node_id string")
    assert rows(mentions.subject(nodes, edges, aliases, " THE X")) == [("edge", "e1"), ("edge", "e2"), ("edge", "e4"), ("neighbour", "y"), ("neighbour", "z"), ("node", "x")]
