"""Each query that has SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from motif_engine.plans import source_queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    number = lambda x: round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted(str([number(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, con, name):
    df = core.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in core.SQL:
        assert got
        return
    cur = con.execute(core.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon(got, df.columns) == canon(cur.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_optional_parts(tmp_path):
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder in ("motif_engine", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{top}/{folder}") else shutil.copy)(f"{top}/{folder}", f"{tmp_path}/{folder}")
    shutil.rmtree(f"{tmp_path}/motif_engine/llm", ignore_errors=True)
    code = """
import __spark_entry__ as e
assert 'pipeline' not in e.queries() and not any(k.startswith('op') for k in e.queries()) and e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
