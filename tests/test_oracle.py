"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from lodegraph.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    found = QUERIES[name](spark, sf_dir)
    rows = found.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    expected = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows_of(found.columns, rows) == rows_of(expected.columns, expected.fetchall())
