from __future__ import annotations

from collections import Counter

import pytest

from lodegraph.llm import sharding


def brute(shards, size):
    """Preference lists written out; turn by turn, each shard claims its first free slot."""
    lists = []
    for s in shards:
        offset, step = sharding._number(s, "offset") % size, sharding._number(s, "step") % (size - 1) + 1
        lists.append([(offset + k * step) % size for k in range(size)])
    owner = [-1] * size
    while -1 in owner:
        for i, wanted in enumerate(lists):
            free = next((x for x in wanted if owner[x] < 0), None)
            if free is not None:
                owner[free] = i
    return owner


@pytest.mark.parametrize(("n", "size"), [(1, 2), (1, 7), (3, 7), (7, 7), (10, 101), (16, 251)])
def test_fill_matches_brute_force(n, size):
    shards = [f"s{i}" for i in range(n)]
    assert sharding.fill_table(shards, size) == brute(shards, size)


def test_shares_are_even_and_removal_moves_little():
    shards = [f"s{i}" for i in range(20)]
    full = sharding.fill_table(shards, 5003)
    assert max(Counter(full).values()) - min(Counter(full).values()) <= 1
    less = sharding.fill_table(shards[:-1], 5003)
    assert sum(a != b for a, b in zip(full, less, strict=True) if a != 19) < 0.1 * 5003


def test_bad_sizes():
    for shards, size in ((["a"], 8), ([], 7), (["a", "a"], 7), ([f"s{i}" for i in range(8)], 7)):
        with pytest.raises(ValueError):
            sharding.fill_table(shards, size)


def test_place(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "q"), (1, "b", "q"), (None, "c", "q"), (2, None, "q")], "doc_id long, text string, shard string")
    rows = sharding.place(df, keep=["text", "shard"]).collect()
    assert len(rows) == 4 and rows[0].asDict().keys() == {"doc_id", "text", "slot", "shard"}
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    table = sharding.fill_table(sharding.SHARDS)
    assert all(sharding.SHARDS[table[r.slot]] == r.shard for r in rows)
    assert sharding.place(df.limit(0)).collect() == []


def test_query(spark, sf_dir):
    from lodegraph.llm.queries import op3_sharding

    rows = op3_sharding(spark, sf_dir).collect()
    table = sharding.fill_table(sharding.SHARDS)
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(sharding.SHARDS[table[r.slot]] == r.shard for r in rows)
