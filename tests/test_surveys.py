"""Markdown, resolution joins, censuses and names on literal fixtures."""

from __future__ import annotations

from lodegraph.functions import names
from lodegraph.operators import censuses, documents, markdown, resolution
from pyspark.sql import functions as F

TEXT = """Title
=====
intro
more
# One ##
```
# not a heading
```
~~~
x
~~~
### Deep
- item
- item

Sub
---
> quote
| a | b |
## Two
end"""


def test_headings_and_their_ancestry(spark):
    lines = documents.numbered_lines(spark.createDataFrame([(1, TEXT), (2, None)], "doc_id int, text string"))
    found = [(r.line, r.level, r.title, r.path) for r in markdown.headings(lines).orderBy("line").collect()]
    assert found == [
        (1, 1, "Title", "Title"), (5, 1, "One", "One"), (12, 3, "Deep", "One / Deep"), (16, 2, "Sub", "One / Sub"), (20, 2, "Two", "One / Two"),
    ]


def test_blocks_partition_the_text(spark):
    lines = documents.numbered_lines(spark.createDataFrame([(1, TEXT + "é"), (2, None)], "doc_id int, text string"))
    rows = markdown.blocks(lines).where("doc_id = 1").orderBy("block").collect()
    assert [r.kind for r in rows] == ["heading", "paragraph", "heading", "fence", "fence", "heading", "list", "blank", "heading", "paragraph", "quote", "table", "heading", "paragraph"]
    data, at = (TEXT + "é").encode(), 0
    for r in rows:
        assert r.start == at
        at += r.n_bytes
    assert at == len(data) + 1
    assert data[rows[3].start :].startswith(b"```\n# not") and rows[3].line_end == 8


def test_routes(spark):
    routes = spark.createDataFrame([("r1", "billing", "GET", "billing.example.com", "/items/:id"), ("r2", "orders", "POST", None, "/items/{id}"), ("r3", "orders-api", "GET", None, "/items/{id}/lines"), ("r4", "me", "GET", "me.example.com", "/items/new")], "route_id string, repo string, method string, host string, template string")
    clients = spark.createDataFrame(
        [(1, "me", "get", "billing.example.com", "/items/7", False), (2, "me", None, "orders.internal", "/items/7", False), (3, "me", None, None, "/items/7", False), (4, "me", "POST", None, "/items/7", True), (5, "x", None, "nowhere", "/items/7/lines", False), (6, "x", "GET", "me.example.com", "/items/new", False)],
        "client_id int, repo string, method string, host string, path string, test boolean",
    )
    assert sorted(tuple(r) for r in resolution.route_matches(clients, routes).collect()) == [(1, "r1", 3), (2, "r2", 2), (4, "r2", 0), (6, "r4", 3)]


def test_heads_tails_scopes_and_overlap(spark):
    refs = spark.createDataFrame([(1, "a.b.c"), (2, "a.x"), (3, "q"), (4, "")], "id int, name string")
    mods = spark.createDataFrame([("a",), ("a.b",), ("b.c",)], "m string")
    assert sorted(tuple(r) for r in resolution.longest_head(refs, mods, "id", "name", "m", "m").collect()) == [(1, "a.b", 1), (2, "a", 1)]
    paths = spark.createDataFrame([(1, "x/y/z"), (2, "w/y/z"), (3, "n")], "id int, p string")
    keys = spark.createDataFrame([("x/y/z",), ("y/z",), ("z",)], "k string")
    assert sorted(tuple(r) for r in resolution.exact_then_tail(paths, keys, "id", "p", "k", "k").collect()) == [(1, "x/y/z", "exact"), (2, "y/z", "tail")]
    uses = spark.createDataFrame([(1, "T", ["own", "used", "own"]), (2, "U", ["own"]), (3, "V", [])], "id int, t string, s array<string>")
    types = spark.createDataFrame([("f1", "T", "used"), ("f2", "T", "other"), ("f3", "U", "own"), ("f4", "U", "own")], "f string, t string, n string")
    assert sorted(tuple(r) for r in resolution.in_scope(uses, types, "id", "t", "s", "f", "t", "n").collect()) == [(1, "resolved", "f1", 1), (2, "ambiguous", None, 2), (3, "external", None, 0)]
    left, right = spark.createDataFrame([("payment-worker",)], "a string"), spark.createDataFrame([("worker payment x",), ("payments",)], "b string")
    assert [tuple(r) for r in resolution.token_overlap(left, right, "a", "b", "a", "b").collect()] == [("payment-worker", "worker payment x", 2)]


def test_the_deepest_section_holds_a_fact(spark):
    sections = spark.createDataFrame([(1, 1, 500, 1), (1, 10, 300, 2), (1, 20, 30, 3), (1, 301, 500, 2)], "d int, line int, line_end int, level int")
    facts = spark.createDataFrame([(1, "a", 5), (1, "b", 25), (1, "c", 299), (1, "d", 501), (2, "e", 1)], "d int, f string, at int")
    assert {r.f: (r.line, r.level) for r in resolution.deepest_container(facts, sections, "d", "f").collect()} == {"a": (1, 1), "b": (20, 3), "c": (10, 2), "d": (None, None), "e": (None, None)}


def test_censuses(spark):
    rows = spark.createDataFrame([("a", i % 7, 1.0 if i else None) for i in range(20)] + [("b", 1, 2.0)], "k string, s int, cost double")
    found = {r.k: (r.n, r.n_subjects, r.examples) for r in censuses.with_examples(rows, ["k"], "s", 3).collect()}
    assert found == {"a": (20, 7, [0, 1, 2]), "b": (1, 1, [1])}
    assert {r.k: (r.n, r.known, r.actual) for r in censuses.spending(rows, ["k"], F.col("s"), F.col("cost")).collect()} == {"a": (20, 19.0, None), "b": (1, 2.0, 2.0)}
    assert {r.k: (r.calls, r.partial) for r in censuses.usage(rows, "k", F.col("cost")).collect()} == {"a": (20, True), "b": (1, True)}
    assert {r.k: r.n for r in censuses.top_and_rest(rows, "k", F.lit(1), 1).collect()} == {"a": 20, "other": 1}
    halves = spark.createDataFrame([("x", "p"), ("x", "p"), ("x", "q"), ("y", "p"), ("y", "q")], "f string, c string")
    assert {r.f: r.parent for r in censuses.majority_parent(halves, "f", "c").collect()} == {"x": "p", "y": None}


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(names.entity_name(F.lit("OrderLines_v2"))) == "order_line" and one(names.entity_name(F.lit("address"))) == "address"
    assert [one(names.folded_path(F.lit(x))) for x in ("a//./b/../c", "..\\x", "a/../..", "")] == ["a/c", "../x", "..", ""]
    assert [one(names.template_tail(F.lit(x))) for x in ("${a}/b/c", "${a}${b}/short", "${a}-longer-name", "none")] == ["b/c", None, "-longer-name", None]
    assert one(names.blob_hash(F.lit("hello\n"))) == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert one(names.tree_bound(F.lit(3), F.lit(2))) == 13 and one(names.token_estimate(F.lit("12345"))) == 2
    assert one(names.claim_budget(F.lit(100), 4.0, 2, 40)) == 2 and one(names.claim_budget(F.lit(10**6), 4.0, 2, 40)) == 40
    assert one(names.document_mode(F.lit("---\nmode: plan\n---\n"), F.lit("docs/adr/1.md"))) == "plan" and one(names.document_mode(F.lit("x"), F.lit("docs/adr/1.md"))) == "decision"


def test_routes_of_the_own_host_are_met_by_host_and_not_among_all_hosts(spark):
    routes = spark.createDataFrame([(f"r{i}", f"h{i}.example.com", "GET", f"h{i}.example.com", "/en/:id") for i in range(30)], "route_id string, repo string, method string, host string, template string")
    clients = [(i, "c", None, f"h{i}.example.com", "/en/5", False) for i in range(30)] + [(99, "c", None, "other.example.org", "/en/5", False), (98, "c", None, None, "/en/5", True), (97, "c", None, None, "/en/5", False)]
    clients = spark.createDataFrame(clients, "client_id long, repo string, method string, host string, path string, test boolean")
    found = resolution.route_matches(clients, routes)
    assert "LeftAnti" in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    assert {(r.client_id, r.route_id, r.score) for r in rows if r.client_id < 90} == {(i, f"r{i}", 3) for i in range(30)}
    assert {(r.client_id, r.score) for r in rows if r.client_id > 90} == {(99, 1), (98, 0)} and len(rows) == 90
