"""Every registered query against its SQL, on the smallest tables."""

import pytest

from strandworks import queries as Q

from .oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_sql(spark, name):
    check(spark, SF, Q.QUERIES[name], Q.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry_and_guard():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
