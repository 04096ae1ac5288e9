import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from test_queries import DATA, compare, sql  # noqa: E402, F401

from linkgraph.llm import queries  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, sql, name):  # noqa: F811
    compare(spark, sql, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() >= 0
