"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle import connect, differences, duck_rows, spark_rows

from tidemark.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = spark_rows(QUERIES[name](spark, SF))
    if name in ORACLE:
        assert differences(got, duck_rows(con, ORACLE[name])) is None


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["bucket", "label", "kind", "share"]
    assert set(e.oracle_sql()) <= set(e.queries())
