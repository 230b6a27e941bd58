"""Windows, units and tiles against plain folds."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import windows


def folded(sizes, most, joint):
    out, held = [], None
    for n in sizes:
        total = None if held is None else held + joint + n if held else n
        if held is None or n > most or held > most or total > most:
            out.append([])
            held = n
        else:
            held = total
        out[-1].append(n)
    return [k for k, group in enumerate(out) for _ in group]


@pytest.mark.parametrize("most, joint", [(10, 0), (10, 1), (1, 0), (25, 3)])
def test_packed(spark, most, joint):
    rng = random.Random(most + joint)
    rows = [(g, i, rng.choice([0, 0, 1, 2, 3, 9, 11, 30])) for g in [*range(30), None] for i in range(rng.randint(1, 25))]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    found = {(r.g, r.i): r.window for r in windows.packed(spark.createDataFrame(shuffled, "g int, i int, n long"), ["g"], ["i"], "n", most, joint).collect()}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        assert [found[r[:2]] for r in mine] == folded([r[2] for r in mine], most, joint)


def sectioned(text, most):
    lines = text.split("\n")
    heads = [(i, line) for i, line in enumerate(lines) if line.startswith("#")]
    size = lambda a, b: len("\n".join(lines[a:b]).encode())

    def by_line(a, b):
        out = []
        for i in range(a, b):
            if not out or sum(len(x.encode()) + 1 for x in lines[out[-1][0] : i + 1]) > most:
                out.append([i, i])
            out[-1][1] = i
        return out

    if not heads:
        return [(a + 1, b + 1, None, None, None, None) for a, b in by_line(0, len(lines))]
    starts = ([(0, "(preamble)")] if heads[0][0] else []) + [(i, h[2:]) for i, h in heads]
    out, held = [], []

    def flush():
        if held:
            out.append((held[0][0] + 1, held[-1][1], len(held), held[0][2] if len(held) == 1 else None, None, None))
            held.clear()

    for (a, path), b in zip(starts, [*(i for i, _ in starts[1:]), len(lines)]):
        n = size(a, b)
        if n > most:
            flush()
            pieces = by_line(a, b)
            out += [(x + 1, y + 1, 1, path, k + 1, len(pieces)) for k, (x, y) in enumerate(pieces)]
            continue
        bytes_held = sum(h[3] for h in held) + max(0, len([h for h in held]) - 1) if held else 0
        if bytes_held and bytes_held + 1 + n > most:
            flush()
        held.append((a, b, path, n))
    flush()
    return out


def test_section_windows(spark):
    rng = random.Random(3)
    line = lambda: "".join(rng.choices("abé ", k=rng.randint(1, 30))).strip() or "x"
    docs = [(0, ""), (1, None), (2, "# only"), (3, "a\n" * 30), (4, "# big\n" + "word " * 40), (5, "x" * 200 + "\n# h\ny")]
    docs += [(10 + i, "\n".join(f"# {line()}" if rng.random() < 0.25 else line() for _ in range(rng.randint(1, 40)))) for i in range(40)]
    rows = windows.section_windows(spark.createDataFrame(docs, "doc_id int, text string"), 60).collect()
    for doc, text in docs:
        got = sorted((r.line, r.line_end, r.n_sections, r.path, r.part, r.parts) for r in rows if r.doc_id == doc)
        assert got == sectioned(text or "", 60), (doc, text)
        lines = (text or "").split("\n")
        assert all(r.n_bytes == len("\n".join(lines[r.line - 1 : r.line_end]).encode()) for r in rows if r.doc_id == doc)


def test_block_windows(spark):
    text = "\n\n".join(f"{'word ' * n}" for n in (3, 5, 2, 30, 4, 1, 8, 6))
    rows = windows.block_windows(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id int, text string"), 60, 12).collect()
    mine = sorted((r.window, r.start, r.n_bytes, r.context_start, r.context_bytes) for r in rows if r.doc_id == 1)
    assert [r.kind for r in rows if r.doc_id != 1] == ["whole_document"] * 2
    assert sum(n for _, _, n, _, _ in mine) == len(text) + 1
    assert all(n <= 60 for _, _, n, _, _ in mine if n < 100)
    for (_, start, n, _, _), (_, after, m, context, size) in zip(mine, mine[1:]):
        assert start + n == after
        if m <= 60:
            assert context is not None and context + size == after and size >= min(12, n)
        else:
            assert context is None and size == 0
    with pytest.raises(ValueError):
        windows.block_windows(spark.createDataFrame([(1, "")], "doc_id int, text string"), 60, 60)


def test_units_partition_and_cut_where_it_is_best():
    rng = random.Random(8)
    for _ in range(200):
        lines = [rng.choice(["", "  indented", "text text", "# head", "def f():", "key:", "é" * 20, "x" * 90]) for _ in range(rng.randint(0, 60))]
        units = windows.cut_units(lines, 60, 120)
        assert [n for a, b, _ in units for n in range(a, b + 1)] == list(range(1, len(lines) + 1))
        assert all(n == len("\n".join(lines[a - 1 : b]).encode()) for a, b, n in units)
    plain = ["text text text"] * 5
    assert windows.cut_units([*plain, "", "text", "", "def f():", "text", *plain], 100, 200) == [(1, 8, 81), (9, 15, 88)]
    assert windows.cut_units([*plain, "# head", "text", "", "late", *plain], 100, 200) == [(1, 5, 74), (6, 14, 92)]
    assert windows.cut_units(["x" * 300, "y"], 100, 200) == [(1, 1, 300), (2, 2, 1)]


def test_text_units(spark):
    docs = [(1, "a\n" * 3000), (2, None), (3, ""), (4, "one"), (5, "\n")]
    rows = windows.text_units(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert sorted((r.doc_id, r.unit, r.n_units, r.line, r.line_end, r.n_bytes) for r in rows) == [(1, 0, 1, 1, 3000, 5999), (4, 0, 1, 1, 1, 3), (5, 0, 1, 1, 1, 0)]


def plain_tile(base, address, members, most):
    rows = []
    for k, member in enumerate(members):
        tile = {**base, "node_rows": [*rows, member], "node_rows_included": k + 1, "node_rows_total": len(members), "node_rows_omitted": len(members) - k - 1, "continuation_address": f"{address}/nodes?after={k + 1}"}
        if len(json.dumps(tile, separators=(",", ":"), ensure_ascii=False).encode()) > most and k:
            break
        rows.append(member)
    n = len(rows)
    return {**base, "node_rows": rows, "node_rows_included": n, "node_rows_total": len(members), "node_rows_omitted": len(members) - n, "continuation_address": f"{address}/nodes?after={n}" if n < len(members) else None}


def test_tiles(spark):
    scopes = {f"s{i}": [f'm{j:05}{"é" * (j % 3)}{chr(34) * (j % 5 == 0)}' for j in range(n)] for i, n in enumerate((0, 1, 5, 13, 14, 200, 2000))}
    df = spark.createDataFrame([(s, f"v/{s}") for s in scopes], "scope string, address string").withColumn("json", F.to_json(F.struct("scope", F.lit("é").alias("label"))))
    rows = windows.tiles(df, spark.createDataFrame([(s, m) for s, ms in scopes.items() for m in ms], "scope string, member string"), {"small": 300, "large": 9000, "tiny": 10}).collect()
    assert len(rows) == 3 * len(scopes)
    for r in rows:
        want = plain_tile({"scope": r.scope, "label": "é"}, f"v/{r.scope}", scopes[r.scope], {"small": 300, "large": 9000, "tiny": 10}[r.profile])
        assert json.loads(r.tile) == want and r.n_bytes == len(r.tile.encode())


def test_a_scope_of_a_million_members(spark):
    members = spark.range(1_000_000).select(F.lit("s").alias("scope"), F.format_string("n%07d", "id").alias("member"))
    scope = spark.createDataFrame([("s", "v", "{}")], "scope string, address string, json string").withColumn("json", F.to_json(F.struct("scope")))
    rows = {r.profile: r for r in windows.tiles(scope, members).collect()}
    assert {p: r.total for p, r in rows.items()} == dict.fromkeys(windows.PROFILES, 1_000_000)
    assert all(r.n_bytes <= windows.PROFILES[p] < r.n_bytes + 25 for p, r in rows.items())
