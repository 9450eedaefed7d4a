"""Every registered query with SQL against DuckDB on the smallest tables."""

import os
import pathlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from corpusmill.plans import registry
from corpusmill.session import shared_dir

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(frame):
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.number)):
            return f"{float(v):.9g}"
        return str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_rows_that_take_their_time_are_many_tasks(spark, sf):
    """Tables of one row group are one task; rows with costly steps are dealt over all cores first."""
    for name in ("title_pools", "volume_links", "plan_verdicts", "read_checks"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan, name


def test_identities_are_judged_in_many_tasks(spark, sf):
    for name in ("full_text_identity", "identity_thresholds"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan, name


@pytest.mark.parametrize("name", ["whole_run", "stale_steps"])
def test_papers_of_a_run_are_dealt_over_all_cores(spark, sf, name):
    """Papers of a small table of one row group are normalized, audited and written by as many tasks as there are cores."""
    runs = lambda: set(pathlib.Path(shared_dir(spark).removeprefix("file://")).glob("corpusmill/run-*/raw"))
    before = runs()
    registry.QUERIES[name](spark, sf).collect()
    written = [len(list(raw.glob("*.parquet"))) for raw in runs() - before]
    assert written and min(written) >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["progress_counters", "run_metadata_counts"])
def test_same_rows_as_sql_with_blank_documents(spark, sf, tmp_path, name):
    """Texts that are null, empty, white space of any kind or a page's control; an id and a source that are null."""
    said = [None, "", "  ", "\n\t", "\xa0\u2003", "\x1c", "Show more", "A text."]
    odd = spark.createDataFrame([(None if i == 9 else 1000 + i, said[i % 8], "en", "web1" if i % 2 else None, 1) for i in range(24)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert rows(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(registry.ORACLE_SQL[name]).df())
