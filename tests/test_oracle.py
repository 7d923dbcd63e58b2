"""Every query with SQL gives the same rows as DuckDB."""

import os

import pytest
from oracle import compare

from factloom import oracle, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query(spark, name):
    compare(spark, queries.QUERIES[name], oracle.ORACLE[name], SF)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_is_registered():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
