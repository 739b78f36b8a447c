"""Registered queries against DuckDB, exactly, and the flagship query."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from airlake.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = list(ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v).removesuffix(" 00:00:00") if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 602
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pending_jobs_gets_real_patches(spark, monkeypatch):
    from airlake.plans import queries

    seen, real = [], queries.M.pending_jobs
    monkeypatch.setattr(queries.M, "pending_jobs", lambda *a: seen.append(a[2].count()) or real(*a))
    QUERIES["m03_pending_jobs"](spark, SF)
    assert seen[0] > 0
