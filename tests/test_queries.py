"""Every registered query: against its SQL, on empty tables, and on hostile ones."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# the subpackage's queries are tested beside it
CORE = [q for q in QUERIES if "weftline.llm" not in QUERIES[q].__module__]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", [q for q in CORE if q in ORACLES])
def test_same_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = duck.execute(ORACLES[name])
    columns = [d[0] for d in got.description]
    order = sorted(df.columns)
    assert order == sorted(columns)
    mine = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = Counter(tuple(plain(r[columns.index(c)]) for c in order) for r in got.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", [q for q in CORE if q.startswith("p") and q[1].isdigit()])
def test_no_rows_from_empty_tables(spark, empty_tables, name):
    assert QUERIES[name](spark, empty_tables).count() == 0


@pytest.mark.parametrize("name", [q for q in CORE if q.startswith("p") and q[1].isdigit()])
def test_hostile_tables(spark, hostile_tables, name):
    QUERIES[name](spark, hostile_tables).collect()


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
