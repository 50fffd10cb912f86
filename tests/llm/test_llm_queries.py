"""Registered corpus queries against their SQL on the small tables."""

import pytest
from compare import compare, connect

from corpus_fixtures import SMALL
from tidegrid.llm import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    left = queries.QUERIES[name](spark, SMALL).toPandas()
    assert len(left)
    if name in queries.SQL:
        assert compare(left, connect(SMALL).execute(queries.SQL[name]).df(), tol=1e-9) is None
