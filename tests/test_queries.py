"""Every query against its SQL twin on the smallest tables."""

import pytest

from seqloom.plans import registry
from tests.duck import assert_same, connection

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_is_lazy_and_has_rows(spark):
    import __spark_entry__

    assert {"pack_group", "chunks", "masked", "share"} == {*__spark_entry__.entry(spark).columns}
    assert QUERIES.keys() <= __spark_entry__.queries().keys()
