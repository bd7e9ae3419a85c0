"""Every registered query against its DuckDB oracle (the driver's check)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF_SMALL)
    assert r["status"] in ("exact", "rows-only"), r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["campaign_id", "campaign_name", "platform"]
    assert df.count() > 0
