from __future__ import annotations

import hashlib

from lodegraph.llm import line_dedup

STRIP = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def brute(rows, least):
    held = {}
    for doc_id, text in rows:
        for line in set(map(key, (text or "").split("\n"))):
            held.setdefault(line, set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or len(held[key(x)]) < least]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rows_of(spark, rows, least, columns="doc_id long, text string", more=()):
    df = spark.createDataFrame([(*r, *more) for r in rows], columns)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_lines(df, min_docs=least).collect()), key=repr)


ROWS = [(1, "A line\nown 1\n\n"), (2, " a LINE \nown 2\na line"), (3, "x\n\tA line"), (3, "x\n\tA line"), (4, None), (5, ""), (None, "a line\nx"), (6, "\n".join(f"long {i}" for i in range(500)) + "\nA LINE"), (7, "É\né")]


def test_against_brute_force(spark):
    for least in (2, 3, 5, 10):
        assert rows_of(spark, ROWS, least) == brute(ROWS, least)


def test_clashing_columns_and_empty_table(spark):
    columns = "doc_id long, text string, kept_text int, n_lines int, row_key int"
    assert rows_of(spark, ROWS, 3, columns, (1, 2, 3)) == brute(ROWS, 3)
    assert rows_of(spark, [], 3) == []


def test_bitmaps_hold_only_words_that_lose_lines(spark):
    df = spark.createDataFrame([(i, "\n".join(["same" if k == 130 else f"{i} {k}" for k in range(200)])) for i in range(4)], "doc_id long, text string")
    maps = line_dedup.keep_bitmaps(df, min_docs=3).collect()
    assert {(m.n_dropped, m.words[0].word, len(m.words)) for m in maps} == {(1, 2, 1)}
    assert all(~m.words[0].bits == 1 << 2 for m in maps)


def test_many_frequent_keys_take_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert rows_of(spark, ROWS, 3) == brute(ROWS, 3)


def test_query_digest(spark, sf_dir):
    from lodegraph.llm.queries import op10_line_dedup

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(docs, 10))
    assert sorted(map(tuple, op10_line_dedup(spark, sf_dir).collect())) == expected
