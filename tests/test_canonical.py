"""The canonical text of a table against a plain JSON writer."""

from __future__ import annotations

import glob
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lodegraph.sources import canonical

SCHEMA = "b int, a string, n struct<z: int, y: array<struct<q: string, p: boolean>>>, d double"


def table(spark, n, seed=0):
    rng = random.Random(seed)
    word = lambda: rng.choice(["x", 'quo"te', "back\\slash", "new\nline : \"k\" : ", "é", "", '  "a" : 1', None])
    rows = [(rng.choice([None, i % 50]), word(), rng.choice([None, (i, [(word(), None), (word(), True)]), (None, [])]), rng.choice([None, 0.5, 2.0])) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def plain(rows):
    def named(r):
        b, a, n, d = r
        inner = n and {"z": n[0], "y": [{"q": q, "p": p} for q, p in n[1]]}
        return json.dumps({"b": b, "a": a, "n": inner, "d": d}, sort_keys=True, indent=2, ensure_ascii=False)

    return sorted(("\n".join("  " + line for line in named(r).split("\n")) for r in rows), key=str.encode)


@pytest.mark.parametrize("n", [0, 1, 7, 300])
def test_text_bytes_and_digest_do_not_depend_on_partitions(spark, tmp_path, n):
    rows, df = table(spark, n)
    texts, digests, lines = [], [], plain(rows)
    for k, parts in enumerate((1, 3, 11)):
        shuffled = df.repartition(parts) if k else df.coalesce(1)
        path = str(tmp_path / str(k))
        manifest = sorted(canonical.write_canonical(shuffled, path, 2000).collect())
        found = [b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path}/part={p}/part-*"))) for p, *_ in manifest]
        at = 0
        for (_, start, size, _), part in zip(manifest, found, strict=True):
            assert (start, size) == (at, len(part))
            at += size
        assert sum(m[3] for m in manifest) == n
        texts.append(b"".join(found))
        row = canonical.canonical_digest(shuffled, 4).first()
        digests.append(row.digest)
        assert (row.n, row.n_bytes) == (n, len(texts[-1]))
    assert len(set(texts)) == len(set(digests)) == 1
    whole = texts[0].decode()
    assert whole == ("[\n" + ",\n".join(lines) + "\n]\n" if n else "[]\n")
    assert json.loads(whole) == [json.loads(t) for t in lines]
    level = whole[2:-3].split(",\n  {") if n else []
    level = [t if i == 0 else "  {" + t for i, t in enumerate(level)]
    while n and (len(level) > 1 or level[0].startswith(" ")):
        level = [hashlib.sha256(",\n".join(level[i : i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)]
    assert digests[0] == (level[0] if n else hashlib.sha256(b"").hexdigest())


def test_ranks_and_offsets(spark):
    rows, df = table(spark, 200, 3)
    found = sorted(canonical.canonical_rows(df).collect())
    assert [r["rank"] for r in found] == list(range(200))
    assert [r.text for r in found] == plain(rows)
    at = 2
    for r in found:
        assert (r.start, r.n_bytes) == (at, len(r.text.encode()))
        at += r.n_bytes + 2


def test_values_of_every_kind(spark):
    row = spark.sql("SELECT map('b', 1, 'a', CAST(NULL AS INT)) AS m, array() AS e, CAST(NULL AS STRUCT<x: INT>) AS n, array(array(1, 2), array()) AS deep, map() AS none, named_struct('y', map('k', array('v'))) AS s, 12.50BD AS dec, true AS t")
    text = canonical.record_text(row.drop("e", "none")).first()[0]
    want = {"m": {"b": 1, "a": None}, "n": None, "deep": [[1, 2], []], "s": {"y": {"k": ["v"]}}, "dec": "DEC", "t": True}
    assert text == "\n".join("  " + line for line in json.dumps(want, sort_keys=True, indent=2).replace('"DEC"', "12.50").split("\n"))


def test_round_trip(spark, tmp_path):
    _, df = table(spark, 120, 5)
    canonical.write_canonical(df, str(tmp_path / "t"), 3000)
    back = canonical.read_canonical(spark, str(tmp_path / "t"), SCHEMA)
    assert canonical.canonical_digest(back).first() == canonical.canonical_digest(df).first()
    assert canonical.canonical_digest(df.withColumn("b", F.col("b") + 1)).first() != canonical.canonical_digest(df).first()
