"""Ledgers, bindings, reading and selection on literal fixtures."""

from __future__ import annotations

import pytest
from lodegraph.operators import binding, ledgers, reading, selection
from pyspark.sql import functions as F


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_refusals_of_two_generations(spark):
    made = lambda *r: spark.createDataFrame(list(r), "k string, at string")
    found = ledgers.reconciled(made(("a", "1"), ("b", "1"), ("c", "1"), ("e", None)), made(("a", "5"), ("d", "6"), ("e", "7")), made(("b", ""), ("a", "")), "k", "at")
    assert rows(found) == [("a", "refused", "1"), ("b", "superseded_by_derivation", "1"), ("c", "withdrawn", "1"), ("d", "refused", "6"), ("e", "refused", "7")]


def test_ledgers_are_only_appended_to(spark):
    made = lambda *r: spark.createDataFrame(list(r), "l string, at int, c string")
    was = made(("grows", 1, "x"), ("grows", 2, None), ("changed", 1, "x"), ("cut", 1, "x"), ("cut", 2, "y"), ("wedged", 1, "x"), ("wedged", 3, "y"))
    now = made(("grows", 1, "x"), ("grows", 2, None), ("grows", 3, "z"), ("changed", 1, "y"), ("cut", 1, "x"), ("wedged", 1, "x"), ("wedged", 2, "n"), ("wedged", 3, "y"), ("new", 1, "x"))
    found = {r.l: (r.n_previous, r.n_added, r.n_broken, r.append_only) for r in ledgers.append_only(was, now, "l", "at", "c").collect()}
    assert found == {"grows": (2, 1, 0, True), "changed": (1, 0, 1, False), "cut": (2, 0, 1, False), "wedged": (2, 1, 0, False), "new": (0, 1, 0, True)}


def test_windows_that_miss_and_double_blocks(spark):
    blocks = spark.createDataFrame([(d, b) for d in (1, 2, 3) for b in range(4)], "d int, b int")
    windows = spark.createDataFrame([(1, 0, 1), (1, 2, 3), (2, 0, 2), (2, 2, 2), (3, 0, 5)], "d int, a int, z int")
    assert rows(ledgers.window_conservation(blocks, windows, "d", "b", "a", "z")) == [(1, 4, 0, 0, 0, True), (2, 4, 1, 1, 0, False), (3, 4, 0, 0, 2, False)]


def test_faults_of_replacements(spark):
    claims = spark.createDataFrame([("a", None), ("b", "a"), ("c", "a"), ("d", "gone"), ("e", "f"), ("f", "g"), ("g", "e"), ("h", "e"), ("i", "i"), ("j", "b")], "k string, r string")
    assert rows(ledgers.replacement_faults(claims, "k", "r")) == [("b", "fork"), ("c", "fork"), ("d", "missing"), ("e", "endless"), ("f", "endless"), ("g", "endless"), ("g", "fork"), ("h", "endless"), ("h", "fork"), ("i", "endless")]
    assert rows(ledgers.replacement_faults(claims.limit(0), "k", "r")) == []


def test_long_chains_end(spark):
    chain = spark.range(1, 200).select(F.col("id").alias("k"), F.when(F.col("id") > 1, F.col("id") - 1).alias("r"))
    assert rows(ledgers.replacement_faults(chain, "k", "r")) == []


def test_answers_are_reused_by_priority(spark):
    windows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "w int, d string")
    journals = spark.createDataFrame([("x", "late", 2), ("x", "early", 1), ("z", "other", 0), (None, "none", 0)], "d string, a string, p int")
    assert rows(ledgers.answer_plan(windows, journals, "w", "d", "a", ["p", "a"])) == [(1, "x", "reused", "early"), (2, "y", "ask", None), (3, None, "ask", None)]


def test_latest_outcome_and_repairs(spark):
    ledger = spark.createDataFrame([("k", 1, "no"), ("k", 2, "yes"), ("k", 3, "no"), ("m", 1, "yes")], "k string, at int, o string")
    assert rows(ledgers.latest_outcomes(ledger, "k", ["at"], "o")) == [("k", "no", 3, 1), ("m", "yes", 1, 0)]


def test_the_first_basis_decides(spark):
    refs = spark.createDataFrame([(1, "n", "t"), (2, "m", "t"), (3, "m", "u"), (4, None, "v")], "r int, name string, tail string")
    by_name = spark.createDataFrame([("A", "n"), ("B", "n")], "t string, k string")
    by_tail = spark.createDataFrame([("C", "t"), ("D", "v"), ("D", "v")], "t string, k string")
    found = binding.resolve_in_order(refs, "r", [("name", "name", by_name, "t", "k"), ("tail", "tail", by_tail, "t", "k")])
    assert rows(found) == [(1, "name", "ambiguous", None, 2), (2, "tail", "resolved", "C", 1), (3, None, "unresolved", None, 0), (4, "tail", "resolved", "D", 1)]


def test_aliases_exact_then_longest(spark):
    patterns = spark.createDataFrame([("s", "@app/*", "src/*"), ("s", "@app/ui/*", "ui/*"), ("s", "@app/ui/x", "exact"), ("s", "*.css", "styles/*"), ("s", "aa*aa", "m/*"), ("t", "@app/*", "no")], "scope string, pattern string, target string")
    names = ["@app/ui/x", "@app/ui/y", "@app/z", "a.css", "aaa", "aaaa", "other", ""]
    refs = spark.createDataFrame(list(enumerate(names)), "ref_id int, name string").withColumn("scope", F.lit("s"))
    assert {r.ref_id: r.path for r in binding.alias_targets(refs, patterns).collect()} == {0: "exact", 1: "ui/y", 2: "src/z", 3: "styles/a", 5: "m/"}


def test_package_roots(spark):
    got = spark.createDataFrame([("@Scope/a_b/deep",), ("lodash.get/x",), ("./here",), ("/abs",), ("",), (None,)], "s string").select(binding.package_root(F.col("s")).alias("p")).collect()
    assert [r.p for r in got] == ["@scope/a-b", "lodash-get", None, None, None, None]


def test_anchors_under_a_pin(spark):
    held = spark.createDataFrame([("r", "p1", "a", "h1"), ("r", "p1", "b", "h2")], "scope string, pin string, path string, blob string")
    anchors = spark.createDataFrame([(1, "r", "p1", "a", "h1"), (2, "r", "p2", "a", "h1"), (3, "r", "p1", "a", "h9"), (4, "r", "p1", "c", "h2"), (5, "r", "p1", "c", "h9"), (6, "x", "p1", "a", "h1")], "id int, scope string, pin string, path string, blob string")
    assert [s for _, s in rows(binding.bound_by_content(anchors, held, "id"))] == ["bound", "pin_differs", "file_version_differs", "same_content_other_path", "not_in_graph", "not_in_graph"]


def test_wiring(spark):
    made = lambda *r: spark.createDataFrame(list(r), "o string, n string")
    found = binding.wiring(made(("a", "x"), ("a", "y"), ("b", "x")), made(("a", "x"), ("c", "x")), made(("b", "?")), "o", "n")
    assert rows(found) == [("a", "x", "wired"), ("a", "y", "declared_unwired"), ("b", "x", "undeterminable")]


def test_spans_are_clipped_by_lines_and_bytes(spark):
    texts = spark.createDataFrame([(1, "a\nb\nc"), (2, "\n".join(str(i) for i in range(1000))), (3, "x" * 70_000 + "\nend"), (4, None)], "d int, text string")
    facts = spark.createDataFrame([(1, 1, 2), (1, 2, 9), (2, 3, 500), (3, 4, 1), (4, 5, 1)], "d int, f int, at int")
    found = {r.f: r for r in reading.read_span(texts, facts, "d", "f", "at", 300, 300).collect()}
    assert (found[1].line, found[1].line_end, found[1].span, found[1].clipped) == (1, 3, "a\nb\nc", False)
    assert (found[2].span, found[2].clipped) == (None, False)
    assert (found[3].line, found[3].line_end, found[3].clipped) == (200, 599, True)
    assert (found[4].line_end, len(found[4].span), found[4].clipped) == (1, 70_000, True)
    assert (found[5].line_end, found[5].span) == (1, "")


def test_quotes_are_located_by_the_first_way(spark):
    text = "One  two *three* Four.\nOne more; one more"
    quotes = [("One more", "exact", 1, 24), ("One two", "whitespace", 1, 1), ("two three", "markup", 1, 5), ("three four", "case", 1, 9), ("none", "missing", 0, None), ("more", "exact", 2, None), ("", "missing", 0, None), (None, "missing", 0, None)]
    df = spark.createDataFrame([(i, text, q[0]) for i, q in enumerate(quotes)], "i int, text string, quote string")
    found = reading.located(df, "text", "quote").orderBy("i").collect()
    assert [(r.method, r.n_places, r.place) for r in found] == [q[1:] for q in quotes]


def test_screens_and_globs(spark):
    texts = ["api_key: abcdefgh1", "card 4111 1111 1111 1111 and 123-45-6789", "calm", None]
    assert [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(reading.screened(F.col("t")).alias("s")).collect()] == [["credential"], ["identifier", "payment"], [], []]
    paths = ["a/b/c.md", "c.md", "src/x1.js", "src/deep/x1.js", "other", None]
    kept = spark.createDataFrame([(p,) for p in paths], "p string").select(reading.left_out(F.col("p"), ["**/*.md", "src/x?.js"]).alias("x")).collect()
    assert [r.x for r in kept] == [True, True, True, False, False, False]


@pytest.mark.parametrize(("size", "expected", "deferred"), [(3, [(2, 2), (3, 6)], 2), (2, [(2, 2)], 3), (100, [(2, 2), (3, 6), (4, 7), (5, 9)], 0)])
def test_batches_take_whole_groups(spark, size, expected, deferred):
    groups = spark.createDataFrame([(1, 9), (2, 2), (3, 4), (4, 1), (5, 2)], "c int, n int")
    found = selection.component_batch(groups, "c", "n", 1, size).orderBy("c").collect()
    assert [(r.c, r.upto) for r in found] == expected
    assert {r.n_deferred for r in found} == {deferred}


def test_recall_weighs_strata(spark):
    samples = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("b", 1, 1), ("b", 0, 0)], "s string, y int, f int")
    population = spark.createDataFrame([("a",)] * 10 + [("b",)] * 20 + [("c",)] * 5, "s string")
    assert rows(selection.recall_estimate(samples, population, "s", F.col("y") == 1, F.col("f") == 1)) == [(4, 20.0, 0.75)]


def test_summaries_count_each_edge_once_per_side(spark):
    members = spark.createDataFrame([("x", "A", "k"), ("y", "A", "l"), ("z", "B", "k")], "node_id string, community string, kind string")
    edges = spark.createDataFrame([("x", "y"), ("x", "x"), ("x", "z"), ("y", "far"), ("far", "z")], "src string, dst string")
    assert rows(selection.summaries(members, edges)) == [("A", 2, "k=1,l=1", 2, 2, 0), ("B", 1, "k=1", 0, 0, 2)]
