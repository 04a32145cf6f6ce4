"""Catalogue queries against their SQL."""

import decimal

import pytest

from graphloom import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events conversations".split()


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    return round(float(v), 6) if isinstance(v, (int, float, decimal.Decimal)) else str(v)


@pytest.mark.parametrize("name", catalogue.ORACLE_SQL)
def test_rows_equal_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cur = db.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_others_run(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
