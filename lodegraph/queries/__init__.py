"""Registered queries, and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodegraph.queries import code, evidence, knowledge, ledgers, mentions, pages, selection, star, surveys, tables, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**star.QUERIES, **tables.QUERIES, **evidence.QUERIES, **pages.QUERIES, **knowledge.QUERIES, **surveys.QUERIES, **ledgers.QUERIES, **selection.QUERIES, **mentions.QUERIES, **code.QUERIES, **windows.QUERIES}
ORACLE_SQL: dict[str, str] = {**star.ORACLE_SQL, **tables.ORACLE_SQL, **evidence.ORACLE_SQL, **pages.ORACLE_SQL, **knowledge.ORACLE_SQL, **surveys.ORACLE_SQL, **ledgers.ORACLE_SQL, **selection.ORACLE_SQL, **mentions.ORACLE_SQL, **code.ORACLE_SQL, **windows.ORACLE_SQL}
