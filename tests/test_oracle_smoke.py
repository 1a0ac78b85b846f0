"""Every query with an oracle must match DuckDB on the smallest scale factor."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, _close, _key, _rows
from tests.conftest import SMOKE_DIR

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "total" in df.columns


def test_every_query_has_a_callable():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, con, key):
    got = entry.queries()[key](spark, SMOKE_DIR).toArrow()
    want = con.sql(ORACLE[key]).to_arrow_table()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    for a, b in zip(sorted(gr, key=_key), sorted(wr, key=_key)):
        assert _close(a, b), (a, b)
