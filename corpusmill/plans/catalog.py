"""Where queries register themselves, with the SQL that gives the same rows on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Words and letters for an engine without Unicode word boundaries.
REAL = """(length(abstract) >= 50 AND len(regexp_extract_all(abstract, '[\\p{L}\\p{M}\\p{N}_''-]*[\\p{L}\\p{M}\\p{N}_][\\p{L}\\p{M}\\p{N}_''-]*')) >= 8
    AND NOT regexp_matches(abstract, '(?is)\\.\\s+(?:proceedings|findings)\\s+of\\s+the\\b.*\\b(?:19|20)\\d{2}\\.?$'))"""


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
