"""Queries of the training-data operators against their SQL twins."""

import pytest

from gridloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(name, same):
    assert same(queries.queries()[name], queries.oracle_sql()[name]) > 0
