"""Every registered query with SQL against it, over whole tables."""

import pytest
from pairs import differences

from crawlspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_pair(spark, name):
    more, fewer, (n, wanted) = differences(spark, "/root/testdata/sf0.001", queries.queries()[name], queries.oracle_sql()[name])
    assert (more, fewer) == ([], []) and n == wanted > 0
