"""Every registered query against its DuckDB oracle (driver-style comparison)."""

import pytest

import __spark_entry__ as E
from oracle import compare, duck_connect

NAMES = sorted(set(E.queries()) - set(E.LLM_QUERIES))      # tests/llm covers the others


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck_connect(sf_dir)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["label", "total", "count"]
    assert df.count() > 0


def test_every_query_has_an_oracle_or_is_listed():
    rows_only = set(NAMES) - set(E.oracle_sql())
    assert rows_only == set()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, sf_dir, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), sf_dir)
    assert r["status"] in ("ok", "rows-only"), r
