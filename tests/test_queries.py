"""Each registered query with a SQL twin gives the twin's rows."""

import datetime
import math
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

TWINS = entry.oracle_sql()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def value(v):
    if isinstance(v, datetime.datetime):
        return str(v.date())
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.9g}"
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, sf, sql, name):
    got = entry.queries()[name](spark, sf)
    want = sql.sql(TWINS[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(value(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(value(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_library_does_not_need_the_corpus_operators():
    import subprocess

    code = "import sys; sys.modules['claimspark.llm'] = None; import claimspark.queries as q; print(len(q.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__))
    assert out.returncode == 0 and int(out.stdout) > 70
