"""Claims of large conversations are compared pair by pair, in cells of bounded size."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lodegraph.operators import claims, pairing
from lodegraph.queries import ORACLE_SQL, QUERIES

CLAIM = "k string, id {}, polarity boolean, modality string, objects array<string>"
TURNS = "conv_id long, turn long, role string, text string"


def brute_force(rows) -> list[tuple]:
    found = []
    for k, a, lp, lm, lo in rows:
        for j, b, rp, rm, ro in rows:
            if None in (k, a, b) or k != j or not a < b:
                continue
            lo, ro = set(lo), set(ro)
            common = len(lo & ro)
            if not common:
                kind = "incomparable"
            elif None not in (lp, rp) and lp != rp:
                kind = "direct_conflict"
            elif None not in (lm, rm) and lm != rm:
                kind = "modality_divergence"
            elif lo == ro:
                kind = "equivalent"
            else:
                kind = "compatible_partial" if 2 * common >= min(len(lo), len(ro)) else "referent_ambiguity"
            found.append((k, a, b, kind))
    return sorted(found)


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    """Conversations of 2, 40, 41 and 1,100 turns, with repeated turns and missing values."""
    rng = random.Random(7)
    said = lambda: " ".join(rng.choice(["not", "alpha", "beta", "gamma", "delta", "Omega", "zeta", "it"]) for _ in range(rng.randrange(9)))
    rows = [(c, t, rng.choice(["user", "assistant"]), said()) for c, n in ((1, 2), (2, 40), (3, 41), (4, 1100)) for t in range(n)]
    rows += [(3, 5, "user", "alpha beta"), (3, 5, "user", "alpha beta"), (3, None, "user", "alpha"), (None, 1, "user", "alpha"), (None, 2, "user", "alpha"), (3, 90, None, "alpha beta"), (3, 91, "user", None)]
    path = tmp_path_factory.mktemp("talks")
    spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def from_sql(talks: str, name: str) -> list[tuple]:
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW conversations AS SELECT * FROM '{talks}/conversations.parquet/*.parquet'")
    return connection.sql(ORACLE_SQL[name]).fetchall()


def test_pairs_of_large_conversations(spark, talks):
    found = [tuple(r) for r in QUERIES["claim_pair_classes"](spark, talks).collect()]
    assert sorted(found) == sorted(from_sql(talks, "claim_pair_classes"))
    assert sum(c == 4 for c, *_ in found) == 1100 * 1099 // 2 and sum(c == 3 for c, *_ in found) > 41 * 40 // 2


def odd_claims(name) -> list[tuple]:
    rng = random.Random(5)
    rows = [(k, name(rng.randrange(60)), rng.choice([True, False, None]), rng.choice(["m", "n", None]), rng.choices("uvwxyz", k=rng.randrange(5))) for k, n in (("a", 45), ("b", 9), ("c", 1), (None, 3)) for _ in range(n)]
    return [*rows, ("b", None, True, "m", ["u"]), ("a", name(3), True, "m", ["u", "v"]), ("a", name(3), True, "m", ["u", "v"])]


@pytest.mark.parametrize("block", [1, 4, 512])
@pytest.mark.parametrize("kind, name", [("long", int), ("string", "n{}".format)])
def test_every_pair_once_whatever_the_block(spark, block, kind, name):
    rows = odd_claims(name)
    found = claims.pair_classes(spark.createDataFrame(rows, CLAIM.format(kind)), ["k"], block=block)
    assert found.columns == ["k", "left_id", "right_id", "class"]
    assert sorted(map(tuple, found.collect())) == brute_force(rows)


def test_histogram_of_large_conversations(spark, talks):
    found = [tuple(r) for r in QUERIES["ten_class_histogram"](spark, talks).collect()]
    assert sorted(found) == sorted(from_sql(talks, "ten_class_histogram"))
    assert sum(n for _, n in found) > 1100 * 1099 // 2


@pytest.mark.parametrize("block", [4, 512])
def test_counts_are_those_of_the_pairs(spark, block):
    rows = odd_claims(int)
    table = spark.createDataFrame(rows, CLAIM.format("long"))
    assert dict(map(tuple, claims.pair_class_counts(table, ["k"], block=block).collect())) == Counter(kind for *_, kind in brute_force(rows))
    assert claims.pair_class_counts(table.limit(0), ["k"]).collect() == []


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_cells_over_batches_and_matches_in_parts(spark, monkeypatch, batch):
    monkeypatch.setattr(pairing, "HELD_PAIRS", 100)
    monkeypatch.setattr(pairing, "HELD_MATCHES", 30)
    rows = odd_claims(int)
    table = spark.createDataFrame(rows, CLAIM.format("long"))
    batches = pairing.cells(table, ["k"], claims.bucket_sizes(table, ["k"]), 8).toArrow().combine_chunks().to_batches(batch)
    found = []
    for part, left, right, number in pairing.met(batches, ["k"]):
        k, ids = part.column("k").to_pylist(), part.column("id").to_pylist()
        found += [(k[a], ids[a], ids[b], pairing.CLASSES[c]) for a, b, c in zip(left, right, number, strict=True)]
    assert sorted(found) == brute_force(rows)


def test_no_pairs_of_no_claims(spark):
    assert claims.pair_classes(spark.createDataFrame([], CLAIM.format("long")), ["k"]).collect() == []


def test_a_large_bucket_is_dealt_over_cells(spark):
    rows = spark.range(3000).select(F.lit("k").alias("k"), F.lit(1).alias("id"), F.lit(True).alias("polarity"), F.lit("m").alias("modality"), F.array(F.lit("x")).alias("objects"))
    held = pairing.cells(rows, ["k"], claims.bucket_sizes(rows, ["k"]), 100).groupBy("_i", "_j").count()
    assert held.agg(F.count("*"), F.sum("count"), F.max("count") < 300).head() == (30 * 31 // 2, 3000 * 30, True)
