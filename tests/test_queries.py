"""Every registered query of the library against SQL."""

import compare
import pytest

from citegraph.plans import code_queries, driver_queries

SF = "/root/testdata/sf0.001"
QUERIES = driver_queries.QUERIES | code_queries.QUERIES
ORACLE_SQL = driver_queries.ORACLE_SQL | code_queries.ORACLE_SQL


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, name):
    assert compare.differences(spark, con, name, QUERIES[name], ORACLE_SQL[name], SF) == ""


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "bm25_topk_batch" in entry.queries()
