"""The subpackage's queries against their SQL over whole tables."""

import pytest

from lociq.llm import queries
from tests.oracle import check


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query(spark, tables, name):
    check(spark, tables, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE])
def test_query_runs(spark, tables, name):
    assert queries.QUERIES[name](spark, tables).count() > 0
