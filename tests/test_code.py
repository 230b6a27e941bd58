"""Call sites, entity layers, obligations and identity closure on literal fixtures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import callsites, entities, identity, obligations, slices

FILES = "file string, grammar boolean, broken boolean, reexports boolean"
BINDINGS = "file string, scope int, name string, kind string, source string, initialized boolean, specifier string, imported string, declaration string"


def bound(spark, calls, scopes, bindings, marks=(), exports=(), files=()):
    frames = (
        spark.createDataFrame(calls, "file string, start int, callee string, name string"), spark.createDataFrame(scopes, "file string, scope int, start int, end int"), spark.createDataFrame(bindings, BINDINGS),
        spark.createDataFrame(list(marks), "file string, position int, name string, mark string"), spark.createDataFrame(list(exports), "file string, exported string, local string"), spark.createDataFrame(files, FILES),
    )
    return {(r.file, r.start): (r.status, r.reason or r.declaration or r.declarations) for r in callsites.bind_calls(*frames).collect()}


def test_innermost_against_brute_force(spark):
    rng = random.Random(2)

    def nested(low, high, depth):
        out = [(low, high)] if depth else []
        while low + 1 < high and rng.random() < 0.8:
            a, b = sorted((rng.randint(low, high), rng.randint(low, high)))
            if b > a and (a, b) not in out:
                out += nested(a, b, depth + 1)
                low = b
            else:
                low += 1
        return out

    intervals = [(k, *i, f"{k}{n}") for k in "xyz" for n, i in enumerate(dict.fromkeys(nested(0, 60, 0)))]
    points = [(rng.choice("xyzw"), rng.randint(-2, 62), n // 2) for n in range(300)] + [("x", None, -1)]
    found = callsites.innermost(
        spark.createDataFrame(points, "k string, at int, n int"), spark.createDataFrame(intervals, "k string, a int, b int, i string"), ["k"], "at", "a", "b", "i"
    ).collect()
    want = []
    for k, at, n in points:
        around = [i for i in intervals if i[0] == k and at is not None and i[1] <= at < i[2]]
        want.append((k, at, n, max(around, key=lambda i: (i[1], -i[2]))[3] if around else None))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_joined_paths(spark):
    cases = [("a/b.js", "./c", "a/c"), ("a/b.js", "../c.js", "c.js"), ("b.js", "./x/./y/../z", "x/z"), ("a/b.js", "../../c", "../c"), ("a/b/c.ts", "..", "a")]
    df = spark.createDataFrame(cases, "file string, rel string, want string")
    assert [r for r in df.select("*", callsites.joined_path(F.col("file"), F.col("rel")).alias("got")).collect() if r.got != r.want] == []


def test_shadowing_imports_and_refusals(spark):
    """
    main.js: `import {run as go, gone} from './lib'; import * as all from './lib'; import def from './two'; import x from 'pack'; import y from './chain'; const req = require('m');`
    `function f() {}` and in a block `{ let f; f(); { f() } }`, in a function with parameter `go`, and so on.
    """
    m = "main.js"
    scopes = [(m, 0, 0, 1000), (m, 1, 100, 200), (m, 2, 120, 160), (m, 3, 300, 400), ("lib.js", 0, 0, 500), ("lib.js", 1, 100, 200), ("chain.js", 0, 0, 10), ("two.js", 0, 0, 10), ("two/index.js", 0, 0, 10), ("bad.js", 0, 0, 50), ("raw.txt", 0, 0, 50)]
    imported = lambda name, specifier, what: (m, 0, name, "import", None, None, specifier, what, None)
    function = lambda file, scope, name, d, source="function_declaration", value=None: (file, scope, name, "function", source, value, None, None, d)
    local = lambda file, scope, name: (file, scope, name, "non_function", "lexical", None, None, None, None)
    bindings = [
        imported("go", "./lib", "run"), imported("gone", "./lib", "gone"), imported("all", "./lib", "*"), imported("def", "./two", "default"), imported("x", "pack", "default"), imported("y", "./chain.js", "run"), imported("twice", "./lib", "twice"), imported("set", "./lib", "set"), imported("t", "./raw.txt", "t"),
        function(m, 0, "f", "f@0"), local(m, 1, "f"), function(m, 2, "f", "f@2"), local(m, 3, "go"), function(m, 0, "h", "h1"), function(m, 0, "h", "h2"), local(m, 0, "req"),
        function(m, 0, "v", "v1"), function(m, 0, "v", "v2", "var", True), function(m, 0, "w", "w1"), function(m, 0, "w", None, "var", False), function(m, 0, "z", "z1"), function(m, 1, "z", "z2"),
        function("lib.js", 0, "run", "lib.run"), function("lib.js", 0, "twice", "t1"), function("lib.js", 1, "twice", "t2"), function("lib.js", 0, "set", "s1"), function("chain.js", 0, "run", "c"), function("bad.js", 0, "b", "b"),
    ]
    marks = [(m, 130, "z", "assigned"), (m, 500, "req", "commonjs"), ("lib.js", 300, "set", "assigned"), (m, 900, "nothing", "assigned")]
    exports = [("lib.js", n, n) for n in ("run", "twice", "set")] + [("chain.js", "run", "run")]
    files = [(f, True, f == "bad.js", f == "chain.js") for f in ("main.js", "lib.js", "chain.js", "two.js", "two/index.js", "bad.js")] + [("raw.txt", False, False, False)]
    cases = {
        (m, 10): ("identifier", "f", ("resolved", "f@0")), (m, 110): ("identifier", "f", ("unresolved", "shadowed_by_non_function_binding")), (m, 130): ("identifier", "f", ("resolved", "f@2")), (m, 160): ("identifier", "f", ("unresolved", "shadowed_by_non_function_binding")),
        (m, 20): ("identifier", "go", ("resolved", "lib.run")), (m, 310): ("identifier", "go", ("unresolved", "shadowed_by_non_function_binding")), (m, 21): ("identifier", "gone", ("unresolved", "unbound_identifier")), (m, 22): ("identifier", "all", ("unresolved", "namespace_import")),
        (m, 23): ("member", "all", ("unresolved", "namespace_import")), (m, 24): ("identifier", "def", ("unresolved", "module_resolution_ambiguous")), (m, 25): ("identifier", "x", ("unresolved", "external_module")), (m, 26): ("identifier", "y", ("unresolved", "re_export_chain")),
        (m, 27): ("identifier", "twice", ("ambiguous", ["t1", "t2"])), (m, 28): ("identifier", "set", ("unresolved", "assigned_binding")), (m, 29): ("identifier", "t", ("unresolved", "unsupported_grammar")), (m, 30): ("identifier", "h", ("ambiguous", ["h1", "h2"])),
        (m, 31): ("identifier", "req", ("unresolved", "commonjs_interop")), (m, 32): ("member", "req", ("unresolved", "commonjs_interop")), (m, 33): ("identifier", "v", ("unresolved", "assigned_binding")), (m, 34): ("identifier", "w", ("resolved", "w1")),
        (m, 35): ("identifier", "z", ("resolved", "z1")), (m, 140): ("identifier", "z", ("unresolved", "assigned_binding")), (m, 36): ("identifier", "nobody", ("unresolved", "unbound_identifier")), (m, 37): ("subscript", None, ("unresolved", "computed_member")),
        (m, 38): ("member", "f", ("unresolved", "method_call_on_local")), (m, 39): ("new", "f", ("unresolved", "new_expression")), (m, 40): ("call", None, ("unresolved", "dynamic_dispatch")), (m, 2000): ("identifier", "f", ("unresolved", "unbound_identifier")),
        ("bad.js", 3): ("identifier", "b", ("unresolved", "parse_failed")), ("raw.txt", 3): ("identifier", "b", ("unresolved", "unsupported_grammar")), ("raw.txt", 4): ("new", "b", ("unresolved", "new_expression")), ("lost.js", 4): ("identifier", "b", ("unresolved", "unsupported_grammar")),
    }
    found = bound(spark, [(*at, callee, name) for at, (callee, name, _) in cases.items()], scopes, bindings, marks, exports, files)
    assert found == {at: want for at, (_, _, want) in cases.items()}
    assert {r[1] for r in found.values() if r[0] == "unresolved"} == set(callsites.REASONS)
    assert bound(spark, [], scopes, bindings, marks, exports, files) == {}


def test_entity_layer(spark):
    tables = [
        ("orders", "a"), ("orders", "b"), ("customers", "a"), ("order_lines", "b"), ("order_summary", "c"), ("order_tags", "c"), ("tags", "a"), ("outbox", "a"), ("batches", "d"), ("shelf_items", "d"), ("notes", "d"), ("audits", "e"), ("policies", "e"),
        ("order_index", "a"), ("profiles", "a"), ("loose", "a"), ("crew_rows", "b"),
    ]
    columns = [
        ("orders", "order_id", True, None), ("orders", "customer_id", False, "customers"), ("orders", "parent_order_id", False, None), ("orders", "batch_id", False, None), ("orders", "ghost_id", False, None), ("customers", "customer_id", True, None),
        ("order_lines", "order_id", False, None), ("order_summary", "order_id", True, None), ("order_summary", "customer_id", False, None), ("order_tags", "order_id", False, None), ("order_tags", "tag_id", False, None), ("tags", "tag_id", True, None),
        ("batches", "batch_id", True, None), ("shelf_items", "batch_id", False, None), ("shelf_items", "item_id", False, None), ("notes", "crew_id", False, None), ("audits", "crew_id", False, None), ("profiles", "customer_id", True, None), ("profiles", "id", True, None),
        ("loose", "order_id", False, None), ("loose", "customer_id", False, None), ("crew_rows", "lead_order_id", False, "order_index"), ("crew_rows", "order_id", True, None), ("orders", "cust_id", False, None),
    ]
    keys = [("orders", "order_id"), ("customers", "customer_id"), ("order_tags", "order_id"), ("order_tags", "tag_id"), ("tags", "tag_id"), ("batches", "batch_id"), ("order_lines", "seq"), ("shelf_items", "seq"), ("profiles", "customer_id"), ("crew_rows", "order_id"), ("crew_rows", "n")]
    enums = [("shelf_items", "item_kind", v) for v in ("orders", "tag", "batch", "nothing")]
    kinds, signals = [("orders",), ("tag",), ("client_batch",), ("ghost_kind",), ("crew",)], [("customer", "code"), ("batch", "code"), ("crew", "code"), ("crew", "events")]
    frame = spark.createDataFrame
    layer = layer_of(frame, tables, columns, keys, enums, kinds, signals)
    decisions = {r.entity: (r.root_table, r.evidence, r.refusal) for r in layer.decisions.collect()}
    assert decisions["order"] == ("orders", "root_table", None) and decisions["crew"] == (None, "referenced_id", None) and decisions["batch"] == ("batches", "root_table", None)
    assert decisions["policy"] == ("policies", "root_table", "single_source_uncorroborated") and decisions["outbox"][2] == "read_model_or_infrastructure_table"
    assert decisions["ghost_kind"][2] == "model_kind_without_schema_evidence" and decisions["parent_order"][2] == "insufficient_schema_evidence" and "cust" not in decisions
    promoted = {e for e, d in decisions.items() if d[2] is None}
    assert promoted == {"order", "customer", "tag", "batch", "crew"}
    audit = {r.table: r.entity or r.reason for r in layer.audit.collect()}
    assert len(audit) == 16
    assert {t: audit[t] for t in ("orders", "order_summary", "policies", "outbox", "batches")} == {"orders": "order", "order_summary": "read_model_or_infrastructure_table", "policies": "single_source_uncorroborated", "outbox": "read_model_or_infrastructure_table", "batches": "batch"}
    relationships = {(r.from_entity, r.relation, r.to_entity, r.cardinality, r.via, r.basis, r.status) for r in layer.relationships.collect()}
    assert relationships == {
        ("customer", "has_many", "order", "1..N", "orders.customer_id", "declared_foreign_key", "schema_declared"), ("order", "has_many", "order", "1..N", "orders.parent_order_id", "fk_shaped_column", "shape_only"), ("batch", "has_many", "order", "1..N", "orders.batch_id", "fk_shaped_column", "shape_only"),
        ("customer", "has_many", "order", "1..N", "orders.cust_id", "fk_shaped_column", "shape_only"), ("customer", "has_many", "order", "1..N", "order_summary.customer_id", "fk_shaped_column", "read_model_evidence"), ("tag", "relates_to", "order", "N..N", "order_tags.tag_id", "link_table", "shape_only"),
        ("batch", "relates_to", "order", "N..N", "shelf_items.item_id", "polymorphic_check_enum", "schema_declared"), ("batch", "relates_to", "tag", "N..N", "shelf_items.item_id", "polymorphic_check_enum", "schema_declared"),
    }
    assert {(r.subject, r.reason) for r in layer.refusals.collect()} == {
        ("orders.ghost_id", "id_column_names_no_promoted_entity"), ("shelf_items.item_id", "polymorphic_reference_not_resolvable_from_schema"), ("order_lines", "detail_table_without_entity_subject"), ("shelf_items", "detail_table_without_entity_subject"),
        ("notes", "detail_table_without_entity_subject"), ("audits", "detail_table_without_entity_subject"), ("loose", "detail_table_without_entity_subject"),
    }
    assert {(r.subject, r.about, r.reason) for r in layer.conflicts.collect()} == {
        ("orders", "order", "entity_name_disagreement"), ("client_batch", "batch", "entity_name_disagreement"), ("ghost_kind", "ghost_kind", "model_declares_entity_schema_has_no_table"), ("client_batch", "client_batch", "model_declares_entity_schema_has_no_table"), ("customer", "customer", "schema_declares_entity_model_has_no_kind"),
        ("orders.parent_order_id", "order", "schema_relationship_has_no_model_edge_kind"),
    }
    covered = layer_of(frame, tables, columns, keys, enums, kinds, signals, ("parent",))
    assert covered.conflicts.where("reason = 'schema_relationship_has_no_model_edge_kind'").count() == 0
    empty = layer_of(frame, [], [], [], [], [], [])
    assert all(df.count() == 0 for df in empty)


def layer_of(frame, tables, columns, keys, enums, kinds, signals, edges=("replaces",)):
    return entities.entity_layer(
        frame(tables, "table string, file string"), frame(columns, "table string, column string, unique boolean, target string"), frame(keys, "table string, column string"), frame(enums, "table string, column string, value string"),
        frame(kinds, "kind string"), frame(signals, "entity string, source string"), edges, {"cust": "customer"},
    )


def test_singular_names(spark):
    cases = {"orders": "order", "policies": "policy", "batches": "batch", "boxes": "box", "class": "class", "bus": "bus", "axis": "axis", "classes": "class", "search_criteria": "search_criterion", "indices": "index", "crew": "crew", "vessel_items": "vessel_item"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [r for r in df.select("*", entities.singular(F.col("t")).alias("got")).collect() if r.want != r.got] == []


def test_obligations_of_each_kind_and_outcome(spark):
    files = [("a/x.js", "one\ntwo words\n"), ("a/y.js", "secret"), ("a/b/z.js", ""), ("ab/q.js", "one"), ("top", "t")]
    symbols = [("run", "a/x.js", "function"), ("run", "a/y.js", "class"), ("stop", "a/x.js", "function"), ("stop", "a/x.js", "class"), (None, "a/x.js", "function")]
    runs = [("ok", 0, True, None), ("ok", 0, None, None), ("bad", 1, True, None), ("quiet", 0, False, None), ("slow", None, None, "ETIMEDOUT"), ("flaky", 0, True, None), ("flaky", 2, True, None)]
    names = [part.split()[0] for part in obligations.SCHEMA.split(", ")]
    rows, want = [], {}

    def add(kind, state, n, **body):
        key = len(rows)
        rows.append(tuple({"claim_id": key // 3, "obligation_id": key, "kind": kind, **body}.get(c) for c in names))
        want[key] = (state, n)

    symbol, text, exact, present, absent, check = obligations.KINDS[:6]
    add(symbol, "underdetermined", 2, symbol="run"), add(symbol, "supported", 2, symbol="run", require_unique=False), add(symbol, "supported", 1, symbol="run", path="a/x.js"), add(symbol, "supported", 1, symbol="run", declaration_kind="class")
    add(symbol, "refuted", 0, symbol="gone"), add(symbol, "underdetermined", 2, symbol="stop", path="a/x.js"), add(symbol, "supported", 1, symbol="stop", path="a/x.js", declaration_kind="class"), add(symbol, "refuted", 0, symbol="stop", path="a/y.js"), add(symbol, "refuted", 0)
    add(text, "supported", 1, path="a/x.js", line=2, quote="wo wo"), add(text, "refuted", 0, path="a/x.js", line=1, quote="two"), add(text, "refuted", 0, path="a/x.js", line=9, quote="one"), add(text, "unverifiable", 0, path="no", line=1, quote="one"), add(text, "unverifiable", 0, path="a/x.js", line=1, quote=" ")
    add(exact, "supported", 3, prefix="a/", paths=["a/x.js", "a/y.js", "a/b/z.js", "a/x.js"]), add(exact, "refuted", 2, prefix="a", paths=["a/x.js", "a/y.js"]), add(exact, "refuted", 3, prefix="a", paths=["a/x.js", "a/y.js", "a/b/z.js", "ab/q.js"]), add(exact, "supported", 1, prefix="a/b", paths=["a/b/z.js"])
    add(exact, "supported", 1, prefix="top", paths=["top"]), add(exact, "supported", 5, paths=[f for f, _ in files]), add(exact, "unverifiable", 0, prefix="a", paths=[]), add(exact, "refuted", 0, prefix="void", paths=["void/x"])
    add(present, "supported", 2, paths=["top", "a/x.js"]), add(present, "refuted", 1, paths=["top", "gone"]), add(present, "unverifiable", 0)
    add(absent, "supported", 0, paths=["a/x.js", "top"], needles=["secret", "three"]), add(absent, "refuted", 1, paths=["a/x.js", "a/y.js"], needles=["secret"]), add(absent, "unverifiable", 0, paths=["a/x.js", "gone"], needles=["zz"]), add(absent, "unverifiable", 0, paths=["top"], needles=[]), add(absent, "refuted", 2, paths=["a/x.js"], needles=["one", "two", "none"])
    add(check, "supported", 1, command="ok"), add(check, "refuted", 1, command="bad"), add(check, "refuted", 1, command="quiet"), add(check, "unverifiable", 1, command="slow"), add(check, "unverifiable", 0, command="never"), add(check, "refuted", 1, command="flaky")
    add("open_question", "underdetermined", 0)
    frames = (spark.createDataFrame(rows, obligations.SCHEMA), spark.createDataFrame(symbols, "name string, file string, kind string"), spark.createDataFrame(files, "path string, text string"), spark.createDataFrame(runs, "command string, exit_code int, matched boolean, error string"))
    found = obligations.evaluated(*frames)
    assert {r.obligation_id: (r.state, r.n_evidence) for r in found.collect()} == want
    open_world = {r.obligation_id: r.state for r in obligations.evaluated(*frames, complete_symbols=False, complete_tree=False).collect()}
    assert [open_world[k] for k in (4, 15, 16, 23, 25, 26)] == ["underdetermined", "refuted", "underdetermined", "underdetermined", "underdetermined", "refuted"]
    assert obligations.evaluated(frames[0].limit(0), *frames[1:]).collect() == []
    with pytest.raises(ValueError):
        obligations.evaluated(frames[0].withColumn("kind", F.lit("guess")), *frames[1:])


def test_verdicts_and_realizations(spark):
    results = [(1, "verification_check_passed", "supported"), (1, "open_question", "underdetermined"), (2, "tree_paths_present", "supported"), (3, "verification_check_passed", "supported"), (3, "code_symbol_declared", "supported"), (4, "source_text_present", "supported"), (5, "source_text_present", "refuted"), (5, "open_question", "underdetermined"), (6, "source_text_present", "unverifiable")]
    claims = [(k, "accepted_design") for k in range(1, 8)]
    frame = spark.createDataFrame([(*r, 1) for r in results], "claim_id int, kind string, state string, n int")
    run = lambda kind: {r.claim_id: (r.verdict, r.realization) for r in obligations.adjudicated(frame, spark.createDataFrame([(k, kind) for k, _ in claims], "claim_id int, claim_kind string")).collect()}
    assert run("accepted_design") == {1: ("underdetermined", "unknown"), 2: ("supported", "partial"), 3: ("supported", "implemented"), 4: ("supported", "unknown"), 5: ("refuted", "not_started"), 6: ("unverifiable", "unknown"), 7: ("underdetermined", "unknown")}
    assert {k: v[1] for k, v in run("historical_design").items()} == {1: "unknown", 2: "unknown", 3: "unknown", 4: "removed", 5: "diverged", 6: "unknown", 7: "unknown"}
    assert {k: v[1] for k, v in run("proposed_design").items()} == {1: "unknown", 2: "not_started", 3: "not_started", 4: "not_started", 5: "diverged", 6: "unknown", 7: "unknown"}
    assert run("statement")[5] == ("refuted", "diverged")


def test_identity_closure_ends_every_component(spark):
    place = lambda k: ("f", k, "s")
    candidates = [("c1", "A", "b1", *place(1)), ("c2", "A", "b1", *place(90)), ("c3", "A", "b2", *place(91)), ("c4", "B", "b3", *place(4)), ("c5", "B", "b4", *place(5)), ("c6", "B", None, *place(6)), ("c7", "B", "b5", *place(7)), ("c8", "B", "b6", *place(92)), ("c9", "B", "b7", "f", 1, "other")]
    documentary = [("d1", *place(1)), ("d4", *place(4)), ("d5", *place(5)), ("d5b", *place(5)), ("d6", *place(6)), ("d7", *place(7)), ("d8", *place(80)), ("d9", *place(81)), ("d10", *place(82))]
    constraints = [("d4", "d8", "must_link", "reviewed"), ("d8", "d4", "cannot_link", "reviewed"), ("d7", "d9", "must_link", "type"), ("c8", "d9", "cannot_link", "reviewed"), ("d1", "d10", "must_link", "reviewed"), ("d1", "lost", "cannot_link", "reviewed")]
    frames = (spark.createDataFrame(candidates, "mention_id string, fact_kind string, basis string, file string, line int, surface string"), spark.createDataFrame(documentary, "mention_id string, file string, line int, surface string"), spark.createDataFrame(constraints, '"left" string, "right" string, disposition string, kind string'.replace('"', "`")))
    receipts = {r.mention_id: (r.disposition, r.n_documentary, r.referent) for r in identity.join_receipts(*frames).collect()}
    assert receipts == {
        "c1": ("joined", 2, "c1"), "c2": ("joined", 2, "c1"), "c3": ("unresolved", 0, None), "c4": ("cannot_link", 2, None), "c5": ("terminal_incomplete", 0, None), "c6": ("terminal_incomplete", 0, None), "c7": ("cannot_link", 2, None), "c8": ("unresolved", 0, None), "c9": ("unresolved", 0, None),
    }
    assert {d for d, _, _ in receipts.values()} == set(identity.DISPOSITIONS)
    components = identity.identity_components(frames[0].where("basis IS NOT NULL"), *frames[1:]).collect()
    assert len(components) == 8 + 9 and {r.status for r in components} == {"blocked", "resolved", "unresolved"}
    relations = spark.createDataFrame([(1, "calls", "c1", "c2", "resolved"), (2, "calls", "c1", "c3", "resolved"), (3, "calls", "c2", "c1", "ambiguous"), (4, "calls", "c2", "nobody", "resolved")], "relation_id int, edge_kind string, from_mention string, to_mention string, status string")
    assert [tuple(r) for r in identity.traversable(relations, identity.join_receipts(*frames)).collect()] == [(1, "calls", "c1", "c1")]
    locators = spark.createDataFrame([("r", "f", 1, "m", "c1"), ("r", "f", 2, "m", "c2"), ("r", "f", 2, "m", "c3")], "repo string, file string, line int, fact_kind string, mention_id string")
    ends = spark.createDataFrame([(1, "from", "r", "f", 1, "m"), (1, "to", "r", "f", 2, "m"), (2, "from", "r", "f", 3, "m"), (2, "to", "r", "f", 1, "x")], "relation_id int, end string, repo string, file string, line int, fact_kind string")
    assert sorted((r.relation_id, r.end, r.mention_id, r.state) for r in identity.anchored(ends, locators).collect()) == [(1, "from", "c1", "anchored"), (1, "to", None, "ambiguous_locator"), (2, "from", None, "no_candidate"), (2, "to", None, "no_candidate")]


def test_slices_grow_within_bounds_and_stand_once(spark):
    edges = [("hub", f"x{i:02}") for i in range(80)] + [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "a"), ("b", "a"), ("p", "q"), ("x00", "near")]
    edges = spark.createDataFrame(edges, "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in ["hub", *(f"x{i:02}" for i in range(80)), *"abcdepq", "near", "alone"]], "node_id string")
    seeds = spark.createDataFrame([("E1", "hub", "hub", 1), ("E1", "x00", "x00", 1), ("E2", "near", "near", 2), ("E2", "x01", "x01", 2), ("E2", "c", "c", 2), ("E2", "b", "b", 2), ("E1", "b", "b", 1), ("E2", "far", "near", 1)], "enumerator string, primary string, node string, hops int")
    lesser = slices.lesser_components(edges, nodes)
    assert {(r.primary, r.node) for r in lesser.collect()} == {("a", n) for n in "abcde"} | {("p", "p"), ("p", "q"), ("alone", "alone")}
    groups = lesser.select(F.lit("E7").alias("enumerator"), "primary", "node").union(spark.createDataFrame([("E4", "all", f"x{i:02}") for i in range(80)] + [("E5", "most", f"x{i:02}") for i in range(80)] + [("E5", "most", "y")] + [("E4", "abcd", n) for n in "dcbaa"], "a string, b string, c string"))
    judged, members = slices.enumerated(seeds, groups, edges)
    assert {(r.enumerator, r.primary): (r.n_members, r.disposition) for r in judged.collect()} == {
        ("E1", "hub"): (None, "over_projection_bound"), ("E1", "x00"): (3, "below_minimum_members"), ("E2", "near"): (3, "below_minimum_members"), ("E2", "x01"): (None, "over_projection_bound"), ("E2", "c"): (5, "slice"), ("E2", "b"): (4, "slice"), ("E1", "b"): (3, "below_minimum_members"),
        ("E2", "far"): (2, "below_minimum_members"), ("E7", "a"): (5, "duplicate_member_set"), ("E7", "p"): (2, "below_minimum_members"), ("E7", "alone"): (1, "below_minimum_members"), ("E4", "all"): (80, "slice"), ("E5", "most"): (81, "over_projection_bound"), ("E4", "abcd"): (4, "duplicate_member_set"),
    }
    kept = members.groupBy("enumerator", "primary").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {(r.enumerator, r.primary, r.n) for r in kept} == {("E2", "c", 5), ("E2", "b", 4), ("E4", "all", 80)}
    assert [r.node for r in slices.top_hubs(edges, nodes, 3).collect()] == ["hub", "b", "c"]
    empty = slices.enumerated(seeds.limit(0), groups.limit(0), edges.limit(0))
    assert all(df.count() == 0 for df in empty)


def test_calls_of_no_module_are_not_joined_by_an_empty_key(spark):
    """Calls without an import all had the null module, and so one task."""
    files = spark.createDataFrame([(f"f{i}.js", True, False, False) for i in range(40)], "file string, grammar boolean, broken boolean, reexports boolean")
    scopes = spark.createDataFrame([(f"f{i}.js", "s", 0, 100) for i in range(40)], "file string, scope string, start long, end long")
    bindings = [(f"f{i}.js", "s", "x", "import", None, None, "./f1" if i % 2 else "pkg", "x" if i % 4 == 1 else None, None) for i in range(40)] + [("f1.js", "s", "x", "function", "function_declaration", False, None, None, "d1")]
    bindings = spark.createDataFrame(bindings, "file string, scope string, name string, kind string, source string, initialized boolean, specifier string, imported string, declaration string")
    marks = spark.createDataFrame([], "file string, position long, name string, mark string")
    exports = spark.createDataFrame([("f1.js", "x", "x")], "file string, exported string, local string")
    calls = spark.createDataFrame([(f"f{i}.js", 5, "identifier", n) for i in range(40) for n in ("x", "y")], "file string, start long, callee string, name string")
    bound = callsites.bind_calls(calls, scopes, bindings, marks, exports, files)
    keys = [line for line in bound._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line]
    assert any("specifier" in line and "imported" in line for line in keys)
    found = {(r.file, r.status, r.reason, r.declaration) for r in bound.collect() if r.file in ("f2.js", "f3.js", "f5.js")}
    assert found == {
        ("f2.js", "unresolved", "external_module", None), ("f2.js", "unresolved", "unbound_identifier", None), ("f3.js", "unresolved", "unbound_identifier", None),
        ("f5.js", "resolved", None, "d1"), ("f5.js", "unresolved", "unbound_identifier", None),
    }
