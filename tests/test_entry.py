"""Every registered query against its SQL twin on the smallest tables, and the contract of the entry module."""

import datetime
import decimal
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import oracle
from lectern.plans.queries import queries

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = queries()[name](spark, str(DATA))
    want = duck.sql(oracle.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    left = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    right = sorted(tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall())
    assert left == right


def test_entry(spark):
    assert set(oracle.oracle_sql()) <= set(queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10


def test_core_does_not_need_the_optional_subpackage():
    code = "import sys; sys.modules['lectern.llm'] = None; import lectern.library, lectern.streaming.ingest, lectern.plans.queries, lectern.plans.oracle; print(sum(m.startswith('lectern.llm.') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()[-1] == "0"
