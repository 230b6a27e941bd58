"""Files, facts, artifacts, extraction, communities."""

from __future__ import annotations

import json

import pytest

from lodegraph.functions import extract
from lodegraph.operators import code
from lodegraph.operators import communities
from lodegraph.sources import artifacts, files
from pyspark.sql import functions as F


def test_walk_reports_what_it_leaves_out(spark, tmp_path):
    for name, size in {"a/x.py": 3, "a/node_modules/y.js": 4, "b/z.min.js": 5, "b/big.txt": 5000, "skip/me/q.txt": 1, "top.txt": 2}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    found = files.walk(spark, str(tmp_path), most_bytes=1000, ignored=("skip/me",)).cache()
    assert {r.path: r.reason for r in found.collect()} == {"a/x.py": None, "a/node_modules/y.js": "vendored", "b/z.min.js": "minified", "b/big.txt": "too_large", "skip/me/q.txt": "ignored", "top.txt": None}
    assert {r.path for r in found.where("content IS NOT NULL").collect()} == {"a/x.py", "top.txt"}
    assert sum(r.n_files for r in files.coverage(found).collect()) == 6
    assert {r.component: r.n_files for r in files.components(found).collect()} == {"a": 2, "b": 2, "skip": 1, ".": 1}


def test_facts_keep_bad_lines(spark, tmp_path):
    rows = [{"kind": "route", "repo": "r", "file": "f", "line": 12, "extra": {"a": 1}}, {"kind": "route", "repo": "r", "file": "f", "line": 2}]
    (tmp_path / "facts.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n{bad\n")
    found = files.read_facts(spark, str(tmp_path)).orderBy(files.fact_key()).collect()
    assert [(r.kind, r.line) for r in found if r.kind == "route"] == [("route", 2), ("route", 12)]
    assert [r.data for r in found if r.kind == "unparsed"] == ["{bad"]


def test_artifacts_verify(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a", None), ("b", "x"), ("b", "x")], "node_id string, label string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    path = str(tmp_path / "graph")
    artifacts.write_graph(nodes, edges, path)
    assert artifacts.read_graph(spark, path)[0].count() == 3
    nodes.limit(1).write.mode("append").parquet(f"{path}/nodes")
    with pytest.raises(ValueError, match="nodes at"):
        artifacts.read_graph(spark, path)


TEXT = """import { a } from './a.mjs'
import os
from x.y import z
app.get('/items/:id', h); fetch("https://h.example/v1")
CREATE TABLE IF NOT EXISTS users (id int); insert into users values (1); CREATE OR REPLACE VIEW "v1" AS SELECT 1
resource "aws_sqs_queue" "jobs" {
A --> B
see Section 4.2.1, throw new BadThing('x')
requests>=2.0
"""


def test_extractors(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None)], "id int, text string")
    names = ("http_client", "js_import", "hcl_resource", "thrown", "diagram_edge", "section_reference")
    found: dict[str, list[str]] = {}
    for r in extract.facts(df, "id", "text", names).orderBy("kind", "ordinal").collect():
        found.setdefault(r.kind, []).append(r.value)
    assert found == {
        "http_client": ["https://h.example/v1"], "js_import": ["./a.mjs"],
        "hcl_resource": ['aws_sqs_queue" "jobs'], "thrown": ["BadThing"], "diagram_edge": ["A --> B"], "section_reference": ["4.2.1"],
    }
    assert "requests" in df.where("id = 1").select(extract.extracted(F.col("text"), "requirement")).first()[0]


def test_label_propagation_separates_cliques(spark):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")]
    labels = {r.node: r.label for r in communities.label_propagation(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert len({labels[f"a{i}"] for i in range(5)}) == 1 and len({labels[f"b{i}"] for i in range(5)}) == 1 and labels["a1"] != labels["b1"]


def test_bounded_descent_reports_withheld(spark):
    pairs = spark.createDataFrame([("r", f"c{i}") for i in range(7)] + [("c0", "d")], "parent string, child string")
    nodes = spark.createDataFrame([(f"c{i}", "K") for i in range(7)] + [("d", "K"), ("r", "R")], "node_id string, kind string")
    rows = communities.bounded_descent(pairs, nodes, spark.createDataFrame([("r",)], "node_id string"), 5, 3).collect()
    assert sorted((r.node, r.depth, r.withheld) for r in rows) == [("c0", 1, 2), ("c1", 1, 0), ("c2", 1, 0), ("c3", 1, 0), ("c4", 1, 0), ("d", 2, 0)]


SQL = """-- CREATE TABLE not_this (a int);
CREATE OR REPLACE TEMPORARY VIEW
  IF NOT EXISTS main."v 1" AS SELECT 'create table nor_this';
create table [dbo].users (id int); CREATE UNIQUE INDEX by_name ON users (name);
INSERT INTO main.users VALUES (1); UPDATE users SET a = 1; DELETE FROM `log`;
ON UPDATE SET NULL"""
JS = """// app.get("/no")
app.get("/items/:id", f); router
  .post('/new', g);
api.delete(`/x/${id}`, h); cache.get("key"); put("/z")"""


def test_statements_and_routes_have_lines(spark):
    df = spark.createDataFrame([(1, SQL, JS), (2, None, "")], "id int, sql string, js string")
    assert sorted((r.line, r.action, r.kind, r.name) for r in code.sql_statements(df, "id", "sql").collect()) == [
        (2, "create", "view", "main.v 1"), (4, "create", "index", "by_name"), (4, "create", "table", "dbo.users"),
        (5, "delete", "table", "log"), (5, "insert", "table", "main.users"), (5, "update", "table", "users"),
    ]
    assert sorted((r.line, r.receiver, r.method, r.path) for r in code.http_routes(df, "id", "js").collect()) == [(2, "app", "get", "/items/:id"), (2, "router", "post", "/new"), (4, "api", "delete", None)]
