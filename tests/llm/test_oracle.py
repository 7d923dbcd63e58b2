"""The operators that SQL can express give the same rows as DuckDB."""

import os

import pytest
from oracle import compare

from factloom.llm import queries, sql

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_query(spark, name):
    assert compare(spark, queries.QUERIES[name], sql.ORACLE[name], SF)
